"""Phrases in the manner of real pages, written without a look at the rules. Every other one (HELD) was never used to write a rule; two of NEGATIVE were."""

POSITIVE = """
The page you requested could not be found.
Sorry, this page isn't available.
404 - File or directory not found.
HTTP Error 503. The service is unavailable.
The server encountered an internal error and was unable to complete your request.
Your connection was interrupted.
This site can't be reached
The requested URL /record/77 was not found on this server.
An unexpected error has occurred. Please try again later.
Error establishing a database connection
Connection timed out
Your session has expired. Please sign in again.
You do not have permission to access this resource.
403 Forbidden
500 Internal Server Error
Request timed out.
Service Temporarily Unavailable
This content is no longer available.
The document you are looking for has been removed.
Fatal error: Uncaught Error: Call to undefined function
java.lang.NullPointerException at org.record.Main.run(Main.java:17)
TypeError: Cannot read properties of undefined
Failed to load resource
Unable to connect to the server
Permission denied
Die angeforderte Seite wurde nicht gefunden.
Es ist ein Fehler aufgetreten.
Die Verbindung wurde unterbrochen.
Der Server antwortet nicht.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Seite nicht verfügbar
Dokument nicht gefunden
Zugriff verweigert
Der Inhalt konnte nicht geladen werden.
Interner Fehler
La page demandée est introuvable.
Une erreur est survenue.
Le serveur ne répond pas.
Votre session a expiré.
Document introuvable
Ce contenu n'est plus disponible.
Service momentanément indisponible
Une erreur inattendue s'est produite.
La connexion a été interrompue.
La página solicitada no existe.
Se ha producido un error.
El servidor no responde.
Su sesión ha expirado.
Documento no encontrado
El contenido no está disponible.
Servicio temporalmente no disponible
No se pudo conectar con el servidor.
JavaScript is required to view this page.
This page requires JavaScript.
You need to enable JavaScript to run this app.
Please turn on JavaScript in your browser.
JavaScript must be enabled
Your browser does not support JavaScript.
Diese Seite benötigt JavaScript.
Bitte aktivieren Sie JavaScript in Ihrem Browser.
JavaScript ist erforderlich.
Ihr Browser unterstützt kein JavaScript.
Veuillez activer JavaScript.
Cette page nécessite JavaScript.
JavaScript doit être activé.
Votre navigateur ne prend pas en charge JavaScript.
Esta página requiere JavaScript.
Por favor, active JavaScript.
Debe habilitar JavaScript para continuar.
Su navegador no admite JavaScript.
Insert text here
Your name here
Enter title here
Text to be added
[Insert speaker name]
{{speaker}}
${title}
<%= member.name %>
{% block content %}
TBD
Content coming soon.
Summary to be completed
Transcript not yet available
TODO: add transcript
Name hier eintragen
Text folgt noch
Hier Text einfügen
Titel fehlt noch
Insérer le texte ici
Texte à compléter
Titre à saisir
Texto por definir
Inserte aquí el texto
Título pendiente
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Dummy text for the layout.
This is placeholder text.
Sample content
The quick brown fox jumps over the lazy dog.
blah blah blah
test test test
asdfasdf
qwertyuiop
foo bar baz
Dies ist ein Blindtext.
Ceci est un texte de remplissage.
Este es un texto de relleno.
undefined
null
NaN
[object Object]
Name: undefined
Speaker: null
undefined undefined
#VALUE!
""".strip().split("\n")

NEGATIVE = """
The committee could not be found a better chair than the one it has.
The request of the member was refused by the House last week.
The service in our hospitals is no longer available to everyone, and that is a scandal.
The archive was moved to the new building in March, at great cost.
Our session has expired under the rules, so I call the vote again.
I ask for permission to view the documents which the ministry keeps from us.
The connection between the two towns was interrupted by the flood for nine days.
This document was not found in the files of the ministry, although we asked for it twice.
The system failed, the minister failed, and the country paid for both.
An error has occurred in the printed record; on page 4 read north for south.
The content of the treaty is not available to members before the debate, I am told.
Nobody enabled the police to search the offices.
The server in the restaurant was refused his wages.
The minister missed the point, and the point is money.
The text of the bill is to be read with the annex.
The answer of the government is pending, as so often.
The report follows the text of the directive word for word.
Please insert the words after five years in paragraph two.
The name of the owner is missing from the register.
Test after test has shown the same result.
No, no, no! This cannot go on.
Hear, hear!
Never, never, never will we accept it.
The word null appears in the contract, and the courts will decide what it means.
The title of the minister is to be confirmed by the committee on Tuesday.
The page who carried the message was late.
We were told that the transcript would follow in due course; it did not.
There is no script for what happened in the northern valleys.
He read from a script, and the script was bad.
Browsers of our history will find no such precedent.
Das Protokoll wurde gestern verschoben, und niemand hat es gemerkt.
Die Sitzung ist abgelaufen, wie wir es erwartet haben.
Die Anfrage der Fraktion wurde bis heute nicht bearbeitet, Herr Minister.
Der Fehler ist im Ministerium aufgetreten, nicht im Parlament.
Der Text des Gesetzes folgt dem Entwurf des Rates.
Die Verbindung nach Norden ist seit Wochen unterbrochen, und die Bahn schweigt.
Der Name des Eigentümers fehlt im Vertrag.
Das Archiv ist nicht mehr zu retten, sagt der Rechnungshof.
Ich bitte Sie, den Titel im Haushalt einzutragen.
Nein, nein, nein, so geht das nicht.
La demande de la commission a été refusée par le gouvernement sans explication.
Le service public n'est plus disponible dans nos vallées, voilà la vérité.
La session a expiré avec le mandat du président.
Une erreur politique est survenue, et elle porte votre nom.
Le texte de la loi est à lire avec son annexe.
Le nom du propriétaire manque dans le registre.
La page est tournée, disent les ministres.
Le titre du rapport est à lui seul un programme.
Non, non et non !
Le discours du ministre ne peut pas être pris au sérieux.
La solicitud de la comisión fue rechazada por el gobierno sin explicación alguna.
El servicio no está disponible en los valles, y nadie responde por ello.
La sesión ha terminado con la votación.
El error del ministro ha costado tres millones.
El texto de la ley se lee con su anexo.
El nombre del propietario falta en el registro.
El archivo no existe para que lo escondan ustedes.
No, no y no.
El título del informe es pendiente de votación en la comisión.
Prueba tras prueba, el resultado es el mismo.
""".strip().split("\n")

DEV, HELD = POSITIVE[::2], POSITIVE[1::2]
