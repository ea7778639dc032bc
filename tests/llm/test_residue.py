"""Problem 8."""

from engramma.llm.residue import Index, excluded, terms, windows

BODY = "I sold the kettle because it reminded me of home. We agreed on 12 euros for the spare key. The session at Hardora Harbour ran 21 minutes late. "
BAD = [
    "Hi {{name}}, here is the recap of ${topic}.", BODY + "My plan for __CITY__ is simple.", "Title: [Insert city here]\n" + BODY, "Today %(date)s and I talked about <TOPIC>.",
    "Lorem ipsum dolor sit amet, quis minim dolore do veniam elit.", BODY + "\n\n## Notes\n\nTexto de relleno, pendiente de sustituir.", "asdf asdf asdf asdf", "test test test 123",
    "user: " + BODY + "\nassistant: Please enable JavaScript to view this conversation.", "Menu\nHTTP 404\nBack to start", '{"error": {"code": 503, "message": "Service Unavailable", "request_id": "4592678347"}}',
    "<html><body><h1>Gateway timed out after 75 s waiting for memory-api (487162c707)</h1></body></html>", "Ihr Browser unterstützt keine Skripte oder sie sind abgeschaltet.",
]
GOOD = [
    BODY, BODY + "I got a 404 error at work again and spent an hour on it.", "Ursula teaches JavaScript; you must enable it in the school browser first, which my uncle forgot. " + BODY,
    BODY + "In the design course Kofi explained why printers use lorem ipsum.", "The mail template writes `{{session.date}}` where the value goes. " + BODY, 'So in Python you write f"{city} waits" and the braces are replaced. ' + BODY,
    '{"stages": [{"units": "$first.units", "time": ["$first.date", ""]}]}', BODY + "[photo: the drafts on my desk] [laughs] …[truncated]", "Our password policy asks for {4,12} characters, e.g. [A-Z] and [0-9]. " + BODY, None, "", "   ", "word " * 60_000,
]


def test_cases(spark):
    rows = [(i, t, "x") for i, t in enumerate(BAD + GOOD)] + [(1000 + i, BODY + f"Nothing of note happened on day {i}.", "x") for i in range(60)] + [(None, BAD[0], "x"), (0, BAD[0], "x")]
    got = {r["doc_id"] for r in excluded(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()}
    assert {t for i, t in enumerate(BAD) if i not in got} == set() and {GOOD[i - len(BAD)] for i in got if len(BAD) <= i < 1000} == set()
    assert got == set(range(len(BAD)))


def test_empty(spark):
    assert excluded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# written apart from the exemplars and from the tables
HELD_OUT = [
    "Bad request. The server was moved.", "Das Dokument konnte nicht geladen werden.", "La sesión no pudo cargarse.", "HTTP 500: Internal Server Error", "404 Not Found", "Error 403: Forbidden.",
    "The document could not be opened. Please try again later.", "This file is no longer available.", "You are not authorized to open this document.", "Your session has expired. Please log in again.",
    "Service Unavailable. The site is down for maintenance.", "The conversation failed to load. Reload the page in a moment.", "Le fichier n'a pas pu être chargé.", "Accès refusé.", "Archivo no disponible.",
    "JavaScript is disabled. Please enable JavaScript to open the document.", "Your browser does not support JavaScript. Turn on JavaScript in your settings.", "This site needs cookies and scripts.", "Bitte aktivieren Sie JavaScript, um das Dokument anzuzeigen.",
    "Veuillez activer JavaScript pour lire ce document.", "Lorem ipsum dolor sit amet, sed do eiusmod tempor.", "Placeholder text. Insert your text here.", "Sample text goes here.", "Texto de ejemplo. Texto de relleno.", "Faux texte, à remplacer.",
    "Dear {{customer.name}}, thanks for visiting.", "Total: ${order_total} due today", "Hello [Your name], welcome back.", "Meet us at <<venue>> tomorrow.", "Status: %(state)s",
]
CONTENT = [
    "The server brought the soup and we moved to a quieter table.", "I could not open the jar, so my neighbour helped.", "We asked for the file and the clerk found it at once.", "My access to the garden ends in May, sadly.",
    "The browser of the archive showed us old maps of the harbour.", "She enabled the alarm and left for work.", "He wrote lorem on the board to explain Latin forms.", "The page boy carried our bags upstairs.", "I requested a window seat and got one.", "Our session ran late, and we loaded the van in the dark.",
]


def test_residue_that_no_exemplar_repeats(spark):
    rows = [(i, t) for i, t in enumerate(HELD_OUT)] + [(100 + i, t) for i, t in enumerate(CONTENT)] + [(1000 + i, BODY + f"Nothing of note happened on day {i}, though the page was loaded with {i} pictures of the session.") for i in range(200)]
    got = {r["doc_id"] for r in excluded(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len([i for i in got if i < 100]) >= 0.9 * len(HELD_OUT) and not [i for i in got if i >= 100]


def test_windows_come_from_the_index():
    index = Index({}, 100)
    text = "Please enable JavaScript to view this page."
    assert [w[1] for w in windows(text, index)] == ["script", "text"]
    index.posting = {t: [] for t in index.posting}
    assert windows(text, index) == []


def test_containment_is_measured_against_retrieved_exemplars():
    index = Index({"the": 90, "to": 80, "in": 80}, 100)
    assert index.best(terms("Please enable JavaScript to view this page.")) is not None
    # words of many exemplars, in no two of them together
    assert index.best(terms("lorem gateway javascript denied expired placeholder cookies")) is None
