"""Example lines that the message model is trained on, composed from short parts by language.

They are training data, not rules: no text is compared with them. Every line has one of the classes

* ``error``: what was asked for isn't here, or couldn't be served;
* ``notice``: the page needs scripts;
* ``helper``: what goes with such a message and says nothing by itself;
* ``filler``: text that only holds a place;
* ``order``: an instruction to the author of a page;
* ``ordinary``: anything else, here only enough to have a contrast where a corpus is tiny.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

CLASSES = ("ordinary", "helper", "error", "notice", "filler", "order")

#: Parts that are joined, each with each, as (class, first parts, second parts); ``|`` parts them.
_PARTS = (
    ("error", "page|the page|this page|that item|this item you were looking for|that page you were looking for|the file you asked for|this resource you requested|the content|article|address|nothing here",
     "not found|was not found|could not be found|cannot be found|does not exist|no longer exists|is no longer available|is not available|has been removed|was deleted|is missing|is gone|has expired|was not located on this server|cannot be displayed"),
    ("error", "we could not|we cannot|we are unable to|sorry we can not", "find that page|find what you requested|locate the file|load this content|display the page|process your request"),
    ("error", "the page you requested|the resource you are looking for|it|or one of its dependencies|the link you followed", "could not be found|could have been removed|had its name changed|may have been moved or deleted|is temporarily unavailable|has been removed or its address has changed"),
    ("error", "the server|our servers|the service|the application|the upstream service|the database|the website|an internal component",
     "failed to respond|did not respond in time|stopped answering|timed out|is unavailable|is temporarily unavailable|is currently unavailable|hit a snag|ran into a problem|is down for maintenance|is overloaded|cannot handle the request right now|encountered an error|has crashed|refused to connect"),
    ("error", "connection|request|session|gateway|database connection", "timed out|timeout|reset by peer|refused|failed|closed unexpectedly|aborted|error|was lost"),
    ("error", "access|permission|request|authorization", "denied|forbidden|refused|blocked|required"),
    ("error", "|<status>|error <status>|http <status>|error", "not found|forbidden|bad gateway|internal server error|service unavailable|service temporarily unavailable|too many requests|unauthorized|gone|bad request|gateway timeout|access denied"),
    ("error", "|<status>|error <status>|oops", "something went wrong|an error occurred|slow down|rate limit reached|slow down rate limit exceeded|down for maintenance|we will be back soon|under maintenance|this page is broken"),
    ("error", "|<status>|error <status>", "wartungsarbeiten|wegen wartung geschlossen|etwas ist schiefgelaufen|interner serverfehler|zugriff verweigert|zu viele anfragen|erreur interne du serveur|en maintenance|accès refusé|une erreur est survenue"
     "|error interno del servidor|en mantenimiento|acceso denegado|algo salió mal|errore interno del server|in manutenzione|accesso negato|qualcosa è andato storto|interne serverfout|in onderhoud|toegang geweigerd|er is iets misgegaan"),
    ("error", "you do not have permission to|you are not allowed to|you are not authorized to", "view this page|access this resource|see this directory|open this document"),
    ("error", "seite|die seite|diese seite|die datei|der artikel|das dokument|dieser inhalt",
     "nicht gefunden|wurde nicht gefunden|existiert nicht|gibt es nicht|gibt es leider nicht mehr|ist nicht mehr verfügbar|wurde gelöscht|wurde entfernt|ist nicht erreichbar|konnte nicht geladen werden"),
    ("error", "der server|der dienst|die verbindung|die anfrage|die datenbank", "antwortet nicht|ist derzeit nicht verfügbar|ist fehlgeschlagen|wurde abgelehnt|ist überlastet|wird gewartet"),
    ("error", "page|la page|cette page|le fichier|le document|le contenu|la ressource", "introuvable|non trouvée|n existe pas|n existe plus|n est plus disponible|a été supprimée|est introuvable|ne peut être affichée"),
    ("error", "le serveur|le service|la connexion|la requête", "ne répond pas|est indisponible|a échoué|a été refusée|a expiré|est en maintenance"),
    ("error", "página|la página|esta página|el archivo|el documento|el contenido|no se encuentra|no se puede mostrar",
     "no encontrada|no existe|ya no existe|ya no está disponible|ha sido eliminada|la página|el recurso solicitado|no se pudo encontrar"),
    ("error", "el servidor|el servicio|la conexión|la solicitud", "no responde|no está disponible|ha fallado|fue rechazada|ha caducado|está en mantenimiento"),
    ("error", "pagina|la pagina|questa pagina|il file|il documento|il contenuto", "non trovata|non esiste|non esiste più|non è più disponibile|è stata rimossa|non può essere visualizzata|è stato eliminato"),
    ("error", "il server|il servizio|la connessione|la richiesta", "non risponde|non è disponibile|non è riuscita|è stata rifiutata|è scaduta|è in manutenzione"),
    ("error", "pagina|de pagina|deze pagina|het bestand|het document|de inhoud", "niet gevonden|bestaat niet|bestaat niet meer|is niet meer beschikbaar|is verwijderd|kan niet worden weergegeven|is niet bereikbaar"),
    ("error", "de server|de dienst|de verbinding|het verzoek", "reageert niet|is niet beschikbaar|is mislukt|is geweigerd|is verlopen|is in onderhoud"),
    ("error", "unhandled exception|fatal error uncaught exception|traceback most recent call last|stack trace|java lang nullpointerexception|system nullreferenceexception",
     "at render|at <*> at <*>|in file line <*>|in module on line|object reference not set"),
    ("notice", "javascript|scripts|scripting|active content|cookies and javascript", "is required|must be enabled|is disabled in your browser|is turned off|needs to be enabled to view this site|is not supported|to run this app"),
    ("notice", "please enable|turn on|you need to enable|please activate|switch on|allow", "javascript|javascript and cookies|scripts to continue|scripting and reload this page|javascript in your browser settings|active content"),
    ("notice", "without javascript|without scripts|unless you allow scripts|without active content|without scripting|unless you enable javascript",
     "this page stays empty|the application does not start|nothing will be displayed|we cannot show the catalogue|this site does not work|the app needs to run"),
    ("notice", "your browser|this app|this application|this site|you have", "does not run scripts|needs scripts to run|needs javascript to work|requires javascript|scripting turned off|javascript disabled"),
    ("notice", "checking your browser", "|to continue|before accessing the page|and reload this page"),
    ("notice", "bitte aktivieren sie|schalten sie|ohne|veuillez activer|activez|sans|por favor active|active|sin|attiva|si prega di attivare|senza|schakel|zet|zonder", "javascript|javascript to continue|javascript in browser|scripts"),
    ("helper", "please|you can|kindly", "try again|try again later|try again in a few minutes|go back|check the address|reload|contact us|wait"),
    ("helper", "return to|go back to|back to|visit", "the home page|the home page or use the search|homepage|the start page|the previous page"),
    ("helper", "if the problem persists|if this keeps happening|for help", "contact the site owner|contact the administrator|contact support|write to us"),
    ("helper", "reference no|reference number|error code|request id|incident|case|code|ray id|trace id|time", "<*>|<status>"),
    ("helper", "the address|the link|the url", "may be mistyped|may be mistyped or the page has moved|may be wrong|is spelled correctly"),
    ("helper", "the server was unable to complete your request|please review the following url|make sure that it is spelled correctly|loading|please wait|sorry|oops|we apologise for the inconvenience", ""),
    ("helper", "zurück|bitte|versuchen sie es|retour|veuillez|volver|por favor|torna|riprova|terug|probeer", "zur startseite|später erneut|später noch einmal|à l accueil|réessayer plus tard|al inicio|más tarde|alla home|più tardi|naar de startpagina|het later opnieuw"),
    ("filler", "your text|your copy|your heading|your content|body copy|text|copy|your slogan", "goes here|goes in here|here|to follow|to come|will go here"),
    ("filler", "sample|dummy|placeholder|example|filler|replace this|insert", "text|copy|heading|paragraph|title|content|headline"),
    ("filler", "hier steht|hier kommt|platzhalter|beispieltext|texte|exemple de texte|texto de|testo|voorbeeldtekst|hier komt", "ihr text|ihr text hin|text|hier|à remplacer|ici|ejemplo|aquí|segnaposto|di esempio|uw tekst"),
    ("filler", "text text text|heading text heading text|title title title|lorem ipsum dolor|blah blah|foo bar baz|asdf asdf qwer|test test|xxx yyy zzz|lorem ipsum", "text text text|lorem ipsum dolor sit amet|blah blah blah|qux foo bar|qwer zxcv hjkl|test test test|xxx xxx"),
    ("order", "write|add|insert|describe|put|enter|type|explain|place|summarise|tell",
     "your story here|the main benefit in two sentences|a catchy slogan in this box|a short intro in your own words|your service here|the team in one sentence|a heading before publishing|the product in this section"),
    ("order", "schreiben sie|beschreiben sie|décrivez|ajoutez|escriba|describa|scrivi|descrivi|schrijf|beschrijf", "hier ihren text|ihr produkt in zwei sätzen|votre service ici|votre équipe en deux phrases|su texto aquí|su servicio en dos frases|qui il tuo testo|il tuo servizio in due frasi|hier uw tekst|uw dienst in twee zinnen"),
    ("ordinary", "the harbour|a morning market|every guest|this old mill|our local team|the committee|each chapter", "opens at noon|sells bread and cheese|meets the judge near the gate|explains the result in detail|was built by the river|is shown on the map|changed the plan last year"),
    ("ordinary", "der hafen|die stadt|jeder gast|das neue haus", "öffnet am mittag|zeigt die kleinen boote|liegt am fluss|wurde im frühjahr gebaut"),
    ("ordinary", "le port|la ville|chaque invité|el puerto|la ciudad|il porto|la città|de haven|het huis", "ouvre à midi|montre les petits bateaux|muestra los barcos|abre por la tarde|mostra le barche|apre a mezzogiorno|toont het kleine schip|ligt aan de rivier"),
    ("ordinary", "how we handle|an essay about|explained simply|a short history of|the cost of", "a <status> page|page not found|maintenance windows|the web server|a stack trace|rate limits|the site owner|placeholders|dummy text|javascript"),
    ("ordinary", "a writer explains why|the guide tells how|readers ask what|an article describes when|designers discuss whether",
     "a server answers too late|page not found is a poor message|lorem ipsum misleads a reader|scripts slow a page down|an error page keeps its visitors|a placeholder stays in print|visitors meet a forbidden page"),
)
#: Words of the customary Latin passage, and keys struck at random.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua nunc tellus felis "
    "cursus porta semper rutrum massa viverra ornare odio dapibus lectus quam velit urna eget vestibulum mauris pellentesque vivamus "
    "praesent curabitur suspendisse nullam donec aenean integer fusce phasellus quis nulla enim justo vitae ultricies"
).split()
STRUCK = "foo bar baz qux asdf qwer qwerty zxcv hjkl xxx yyy zzz blah test".split()


def seeds() -> Iterator[tuple[str, str]]:
    """(class, line) of all examples."""
    for kind, first, second in _PARTS:
        for a, b in product(first.split("|"), second.split("|")):
            yield kind, f"{a} {b}".strip()
    for words, n in ((LATIN, 5), (LATIN, 9), (STRUCK, 6)):
        for k in range(2 * len(words)):
            yield "filler", " ".join(words[(k * (3 + j) + j * j) % len(words)] for j in range(n))
