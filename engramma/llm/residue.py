"""Problem 8: documents with template residue, filler, error messages or script notices instead of content.

Labelled exemplars of residue, sentence by sentence, are kept in an inverted index (term to exemplars). A first pass over
the corpus counts in how many documents each term occurs. A second one cuts every document into passage windows (sentences
and lines; what stands between template signs is a window of its own), retrieves the exemplars that share a telling term
with a window, and scores the window by its TF-IDF containment in the best of them: the share of its weight that terms of
that one exemplar cover. Terms that no exemplar has weigh what their document frequency says; they are joined in only for
windows that could still reach the bound. Covered windows are residue; a document goes if it consists of residue, or has
it in place of a section's body, or has an unfilled field.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.session import stored

#: A window is residue from this containment on.
COVERAGE = 0.8
#: A document consists of residue from this share of its words on, furniture and speaker labels aside.
SHARE = 0.6
#: An exemplar's terms are telling if at most this share of the documents has them, its rarest one up to the second share; of an
#: exemplar of common words only, its heaviest pair of neighbours is.
RARE, RAREST = 0.02, 0.1

# Labelled exemplars: fixed values, one a sentence. 9 stands for any number, host for any host name, ref for any reference.
EXEMPLARS: dict[str, str] = {
    "filler": """
Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
This is placeholder text
Replace it with the page
Replace this with your own page text
Sample text goes here
Second paragraph of sample text
Text to follow
Content coming soon
Coming soon
To be added later
Insert your text here
Add your notes here
Enter your text here
Dummy text for layout purposes only
Filler text for the page
asdf asdf jkl qwerty qwertz xxx blah foo bar baz test
test test test
Please ignore this test
Hier steht Blindtext, der später durch die Seite ersetzt wird
Hier steht später der Text
Platzhaltertext
Texte de remplissage, à remplacer par la page
Faux texte
Texte à venir
Texto de relleno, pendiente de sustituir
Texto de ejemplo
""",
    "error": """
Error 9: Bad Gateway
Bad Gateway
HTTP/1.1 9 Service Unavailable
Error 9: Internal Server Error
Bad Request
Too Many Requests
Page Not Found
Forbidden
Gone
Unauthorized
Gateway Timeout
Method Not Allowed
Please try again in a few minutes
Please try again later
Try again in a moment
Oops, something went wrong while loading this page
Oops
Uh-oh
Sorry, an error occurred while loading the page
An unexpected error has occurred
code 9
The page is currently unavailable
This page isn't available right now
Contact the administrator
Please contact the administrator if the problem persists
Go back to the start page
The page has been removed
The page has been deleted
The page was moved
The server is being moved
This page is being moved
Reload the page in a moment
Please reload the page
The page failed to load
The page could not be loaded
The page could not be found on this server
The page could not be opened
The page could not be generated at this time
Our team has been notified
Sorry, our team has been notified of the problem
The page was blocked by the server
The page was not found
The page you are looking for could not be found on this server
The page you requested no longer exists
Quote reference ref 9
Reference ref
Your request timed out
Your request has been blocked
This page isn't working right now
HTTP 9
The service is temporarily unavailable owing to maintenance
The site is down for maintenance
You have been rate limited; retry after 9 seconds
Too many requests, slow down and retry later
Gateway timed out after 9 s waiting for the api (ref)
Upstream server timed out after 9 seconds
Access denied
You do not have permission to view this page
You are not authorized to view this page
Your session has expired
Please sign in again to continue
Please log in again to continue
Log in again
Traceback (most recent call last)
File "page.py", line 9, in load
return page[key]
raise error from none
This shared page has been deleted or is no longer available
The page is no longer available
We're sorry, the page could not be generated
Sorry, we could not load the page
TimeoutError KeyError ConnectionError ValueError TypeError IndexError RuntimeError: page 9
Connection refused
Connection timed out
{"error": {"code": 9, "message": "Not Found / Service Unavailable / Bad Gateway / Gateway Timeout / Internal Server Error / Forbidden / Unauthorized / Too Many Requests / Bad Request / Gone", "request_id": "9", "status": 9, "type": "error", "detail": null, "details": null}}
Fehler 9: Die angeforderte Seite wurde nicht gefunden
Die Seite wurde nicht gefunden
Die Seite konnte nicht geladen werden
Die Seite ist nicht verfügbar
Seite nicht verfügbar
Der Dienst ist vorübergehend nicht verfügbar
Versuchen Sie es in 9 Sekunden noch einmal
Bitte versuchen Sie es später erneut
Zugriff verweigert
Ihre Sitzung ist abgelaufen, bitte melden Sie sich erneut an
Erreur 9 : la page demandée est introuvable
La page n'a pas pu être chargée
Page non trouvée
Le service est momentanément indisponible
La page est indisponible
Réessayez plus tard dans 9 secondes
Veuillez réessayer dans 9 secondes
Accès refusé
Votre session a expiré, veuillez vous reconnecter
Error 9: no se encontró la página solicitada
Página no disponible
La página no está disponible
La página no pudo cargarse
No se pudo cargar la página
El servicio no está disponible por el momento
Inténtelo de nuevo en 9 segundos
Vuelva a intentarlo dentro de 9 segundos
Inténtelo más tarde
Acceso denegado
Conexión rechazada
Su sesión ha caducado, inicie sesión de nuevo
""",
    "script": """
You need to enable JavaScript to run this app
Please enable JavaScript and cookies to view this page
Please enable JavaScript to continue
Sorry, you must enable JavaScript and cookies in order to view this page
JavaScript is required to view this page
Sorry, you must turn on browser scripts and reload this page
In order to go on, enable scripting before opening this page in your browser
For the full view, enable browser scripts before opening the page
For the full view, enable JavaScript and cookies before opening the shared page
To continue, allow scripts and reload the shared page
Activate scripting to view the page
Allow JavaScript and reload
JavaScript is disabled in your browser
Turn it on and reload the page
Turn on JavaScript in your browser settings
Your browser is not supported
Your browser does not support JavaScript
Allow scripts for host to load the page
Checking your browser before opening host
Checking your browser before accessing the page
This requires scripting to be switched on
This page requires cookies and scripts
This page needs JavaScript to be switched on
This site requires cookies
Please enable cookies
Update your browser settings to continue
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen
Ihr Browser unterstützt keine Skripte oder sie sind abgeschaltet
JavaScript ist in Ihrem Browser deaktiviert
Skripte sind in Ihrem Browser deaktiviert
Veuillez activer JavaScript pour afficher cette page
Votre navigateur ne prend pas en charge les scripts
Les scripts sont désactivés dans votre navigateur
Active JavaScript para ver esta página
Su navegador no admite scripts
Su navegador tiene los scripts desactivados
""",
    "field": """
{{name}}
${name}
#{name}
{name}
%(name)s
<%= name %>
<<name>>
<<the name>>
<NAME>
%%name%%
@@name@@
__NAME__
[NAME]
[Insert the name]
[Insert name]
[Your name]
[Your own name]
[Enter name]
[Enter the name]
[Add name]
[Add a name]
""",
}
# What can be loaded, what can be done with it, and how scripts are allowed, each as one term, so that an exemplar
# stands for all.
THINGS = set(
    "page pages request memory memories session sessions transcript transcripts summary summaries conversation conversations chat chats export memory document documents file files content view site website article record resource item list link message "
    "seite sitzung zusammenfassung unterhaltung dokument datei inhalt gespräch página sesión conversación resumen documento archivo contenido résumé conversation fichier contenu transkript transcripción transcription".split()
)
SHOWING = set("load loading loaded open opening opened view read see display displayed show shown access accessing laden geladen öffnen geöffnet anzuzeigen anzeigen afficher charger chargé chargée ouvrir lire ver cargar cargarse cargada cargado abrir mostrar leer".split())
ENABLING = set("enable enabled enabling activate activated activating allow allowed unlock unlocked switch switched turn turned aktivieren aktiviert einschalten activer activez activé autoriser activar active habilite habilitar permita".split())
_CLASSES = {w: "⟨show⟩" for w in SHOWING} | {w: "⟨thing⟩" for w in THINGS} | {w: "⟨enable⟩" for w in ENABLING}
#: Terms that stand for a value; they weigh nothing.
SLOTS = {"9", "ref", "host"}

_TOKEN = re.compile(r"[^\W_]+")
_HOST = re.compile(r"(?<!\w)/[\w.-]+(?:/[\w.-]+)+|\b[a-z0-9]+(?:[-.][a-z0-9]+)*\.[a-z]{2,}\b")
_DOTTED = re.compile(r"\.[a-z]{2}")
#: Template signs with what stands between them.
_CHUNK = re.compile(r"(?=[{$#%<@_\[])(?:(\{\{|[$#]\{|(?<![\w$#%{\"'])\{(?!\{)|%\(|<%[=-]?|<<|(?<!<)<(?=[A-Z])|%%|@@|(?<!\w)__(?=[A-Z])|\[)\s*([A-Za-z_][^\n{}<>\[\]%@\"'()]{0,60}?)\s*(\}\}|\}(?!\})|\)[sd]|%>|>>|>|%%|@@|__|\]))")
_CLOSES = {"{{": "}}", "${": "}", "#{": "}", "{": "}", "%(": ")", "<%": "%>", "<<": ">>", "<": ">", "%%": "%%", "@@": "@@", "__": "__", "[": "]"}
_UPPER = re.compile(r"[A-Z]{3,}(?:[ _][A-Z]+)*|[A-Z][A-Z_]{2,}")
_NAMED = re.compile(r"[A-Za-z_][\w.]*")
#: Code and quotations, where a field is talked about and not left over.
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|(?<!\w)[fFrRbB]{1,2}(\"|').*?\1|[\"“„«'‘]\s*(?:\{\{|[$#]\{|\{|%\(|<%|<<|<|%%|@@|__|\[)[^\s\"”“»'’]{1,40}?(?:\}\}|\}|\)s|%>|>>|>|%%|@@|__|\])\s*[\"”“»'’]", re.S)
_TAG = re.compile(r"</?(?:html|body|h1|h2|p|div|noscript|head|title|span|br|pre|code|center|hr)\b[^>]*>", re.I)
_BREAK = re.compile(r"(?<=[.?!…])[\"”)]*\s+|\r\n|\r|\n|(?=(?<!\A)```)")
_LABEL = re.compile(r"^(?:\[\d\d:\d\d\]\s*)?(?:\*\*)?([^\W\d][\w.-]{0,20})(?:\*\*)?(?::(?:\*\*)?| —| –)\s+")
_NAV = re.compile(r"\s\|\s|^\W*©|^\W*$", re.I)
_HEADING = re.compile(r"^#{1,6}\s|:$|^[\w '’—-]{1,60}$")
#: Page furniture: copyright lines, menus of words between bars, links that skip, and titles of sites at a line's end.
_FURNITURE = re.compile(
    r"(?m)©\s*\d{4}(?:\s+\w+)?|(?:\b[A-Z][\w’']{2,20}\s\|\s)+[A-Z][\w’']{2,20}\b|\b(?:Skip to content|Back to (?:start|top))\b|\bMenu\s*$"
    r"|\b[A-Z]\w+ (?:Memories|Chats?|Archives?|Notes|Hub|Blog|News|Forum|Docs|Journal)\s*$|\b[A-Z]\w+ [–-] (?:shared )?(?:transcript|conversation|chat|page|document)\s*$"
)


class _Terms(dict):
    """Words with their terms, found out once each."""

    def __missing__(self, w: str) -> str:
        if len(self) > 500_000:
            self.clear()
        t = self[w] = _CLASSES.get(w, w) if w.isalpha() else "9" if w.isdigit() else "ref" if len(w) >= 7 and any(c.isdigit() for c in w) else w
        return t


_TERM = _Terms().__getitem__


def terms(text: str) -> list[str]:
    """Lower-case terms; numbers, host names, reference codes, things and what is done with them become classes."""
    low = text.lower()
    if _DOTTED.search(low) or "/" in low:
        low = _HOST.sub(" host ", low)
    return list(map(_TERM, _TOKEN.findall(low)))


def field_terms(start: str, inside: str, stop: str) -> list[str]:
    """The terms of a template field: its signs, the kind of its name, and in square brackets its first word."""
    start = "<%" if start.startswith("<%") else start
    fits = stop.startswith(_CLOSES[start])
    upper = start in ("[", "<", "__")
    kind = "⟨upper⟩" if upper and _UPPER.fullmatch(inside) else "⟨name⟩" if not upper and _NAMED.fullmatch(inside) else "⟨words⟩"
    first = [f"⟨first⟩ {inside.split()[0].lower()}"] if start == "[" and kind == "⟨words⟩" else []
    return [f"⟨{start}", f"{stop[:2] if fits else '?'}⟩", kind, *first]


def fields(text: str) -> list[list[str]]:
    """The terms of everything between template signs."""
    return [field_terms(*m.groups()) for m in _CHUNK.finditer(text)]


class Index:
    """The exemplars by their terms, weighed by ``weight`` (of a term; unseen ones weigh most)."""

    def __init__(self, frequency: dict[str, int], total: int) -> None:
        self.frequency, self.total = frequency, total
        self.kind: list[str] = []
        self.posting: dict[str, list[int]] = {}
        self.telling: set[str] = set()
        self.pairs: set[tuple[str, str]] = set()
        self.weights: dict[str, float] = {}
        for kind, texts in EXEMPLARS.items():
            for text in filter(None, texts.split("\n")):
                said = fields(text)[0] if kind == "field" else terms(text)
                got = set(said) - SLOTS
                for t in got:
                    self.posting.setdefault(t, []).append(len(self.kind))
                    self.weights[t] = self.weight(t)
                rarest = sorted(got, key=lambda t: (-self.weights[t], t))
                self.telling |= {t for i, t in enumerate(rarest) if frequency.get(t, 0) <= (RAREST if i == 0 else RARE) * total}
                if self.telling.isdisjoint(got - set(_CLASSES.values())) and len(said) > 1:
                    self.pairs.add(max(zip(said, said[1:]), key=lambda p: (self.weights.get(p[0], 0) + self.weights.get(p[1], 0), p)))
                self.kind.append(kind)
        self.telling -= set(_CLASSES.values())

    def weight(self, term: str) -> float:
        return math.log(1 + self.total / max(1, self.frequency.get(term, 1)))

    def tells(self, got: list[str]) -> bool:
        """Whether terms in their order have a telling one, or a telling pair."""
        return not self.telling.isdisjoint(got) or not self.pairs.isdisjoint(zip(got, got[1:]))

    def best(self, got: list[str]) -> tuple[int, float, float, list[str]] | None:
        """(exemplar, covered weight, weight of known terms, unknown terms) of the exemplar that covers most of a window, with
        the one of its class that covers most of the rest (a sentence may join two); None if the bound is out of reach.

        An unknown term weighs at least as one that all documents have.
        """
        covered: dict[int, float] = {}
        known, unknown = 0.0, []
        for t in got:
            if t in SLOTS:
                continue
            w = self.weights.get(t)
            if w is None:
                unknown.append(t)
                continue
            known += w
            for e in self.posting[t]:
                covered[e] = covered.get(e, 0.0) + w
        if not covered or known < COVERAGE * (known + math.log(2) * len(unknown)):
            return None
        e = max(covered, key=lambda k: (covered[k], -k))
        mine = {t for t in got if t not in SLOTS}
        if len(mine) > 1 and sum(e in self.posting.get(t, ()) for t in mine) < 2:
            return None  # one word in common is no passage in common
        second: dict[int, float] = {}
        for t in got:
            if t in self.weights and e not in self.posting[t]:
                for k in self.posting[t]:
                    if self.kind[k] == self.kind[e] != "field":
                        second[k] = second.get(k, 0.0) + self.weights[t]
        most = covered[e] + max(second.values(), default=0.0)
        return (e, most, known, unknown) if most >= COVERAGE * (known + math.log(2) * len(unknown)) else None


def vocabulary() -> list[str]:
    """All terms of the exemplars."""
    return sorted({t for kind, texts in EXEMPLARS.items() for text in texts.split("\n") if text for t in (fields(text)[0] if kind == "field" else terms(text))})


Window = tuple[int, str, int, bool | None, float, float, list[str]]


def windows(text: str, index: Index) -> list[Window]:
    """The windows of a text that an exemplar may cover: (number, class, words, opens a section's body or None without a telling
    term, covered weight, weight of known terms, unknown terms).

    Negative numbers are fields. A last entry of class ``text`` has the number of content words; without it there is none.
    """
    out: list[Window] = []
    if any(fields(text)):
        for got in fields(_CODE.sub(" ", text)):
            if (b := index.best(got)) is not None and index.kind[b[0]] == "field":
                out.append((-1 - len(out), "field", 1, False, *b[1:]))
    if not index.tells(terms(text)):
        return [*out, (0, "text", 0, False, 0.0, 0.0, [])] if out else []
    text = _FURNITURE.sub("\n", text)
    lines: list[tuple[list[str], bool]] = []  # terms, opens a section's body
    content, turns, heading, first_user = 0, 0, False, None
    for raw in _BREAK.split(_TAG.sub("\n", text)):
        s = raw.strip() if raw else ""
        if not s:
            continue
        label = _LABEL.match(s)
        body = s[label.end() :] if label else s
        if label:
            turns += 1
            who = label.group(1).lower()
            if turns == 1 and who == "user":
                first_user = 0
            elif first_user is not None:
                content -= first_user if turns == 2 and who != "user" else 0  # the single user turn that came before
                first_user = None
        got = terms(body)
        short = len(got) <= 6 and not label and body[-1:] not in ".?!:" and not index.tells(got)
        counted = 0 if short or _NAV.search(s) else len(got)
        content += counted
        if first_user is not None:
            first_user += counted
        lines.append((got, heading or (label is not None and label.group(1)[:1].isupper())))
        heading = len(got) <= 9 and bool(_HEADING.search(s))
    near = set()
    for i, (got, _) in enumerate(lines):
        if index.tells(got):
            near |= {i - 1, i, i + 1}  # a message goes on in the sentences beside
    for i in sorted(near):
        if 0 <= i < len(lines) and (b := index.best(lines[i][0])) is not None:
            got, opens = lines[i]
            out.append((i, index.kind[b[0]], len(got), opens if index.tells(got) else None, *b[1:]))
    return [*out, (len(lines), "text", max(content, 0), False, 0.0, 0.0, [])] if out else []


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents of this batch with it)."""
    for batch in batches:
        frequency: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            frequency.update(set(terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(frequency), pa.string()), pa.array(list(frequency.values()), pa.int64())], names=["term", "n"])


_SCHEMA = "doc_id long, win int, kind string, words int, opens boolean, covered double, known double, unknown array<string>"


def residue(documents: DataFrame) -> DataFrame:
    """Scores of the documents with residue windows: (doc_id, fields, residue_words, content_words, filled_section).

    Null, empty and blank texts give no row; documents with a null doc_id are left out; repeated ids are taken once.
    """
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    df = stored(docs.select("text").mapInArrow(_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("df")), "terms")
    total = docs.count()
    asked = spark.createDataFrame([(t,) for t in vocabulary()], "term string")  # as many as the exemplars have
    shared = spark.sparkContext.broadcast(({r["term"]: r["df"] for r in df.join(F.broadcast(asked), "term").collect()}, total))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.string())]
        names = ["doc_id", "win", "kind", "words", "opens", "covered", "known", "unknown"]
        for batch in batches:
            rows = [(doc, *w) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in windows(text, index)]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    seen = stored(docs.mapInArrow(scan, _SCHEMA).dropDuplicates(["doc_id", "win", "kind"]), "residue")
    open_terms = seen.where("size(unknown) > 0").select("doc_id", "win", F.explode("unknown").alias("term")).join(df, "term", "left")
    rest = open_terms.groupBy("doc_id", "win").agg(F.sum(F.log(1 + F.lit(float(total)) / F.coalesce("df", F.lit(1)))).alias("rest"))
    scored = seen.where("kind <> 'text'").join(rest, ["doc_id", "win"], "left").withColumn("containment", F.col("covered") / (F.col("known") + F.coalesce("rest", F.lit(0.0))))
    hit = F.col("containment") >= COVERAGE
    section = F.col("opens").isNotNull() & ((F.col("kind") == "filler") | F.col("opens") & F.col("kind").isin("error", "script") & (F.col("words") >= 4)) & (F.col("words") >= 3)
    per_doc = scored.groupBy("doc_id").agg(
        F.count_if(hit & (F.col("kind") == "field")).alias("fields"),
        F.coalesce(F.sum(F.when(hit & (F.col("kind") != "field"), F.col("words"))), F.lit(0)).alias("residue_words"),
        F.coalesce(F.bool_or(hit & section), F.lit(False)).alias("filled_section"),
    )
    content = seen.where("kind = 'text'").groupBy("doc_id").agg(F.max("words").alias("content_words"))
    return per_doc.join(content, "doc_id")


def excluded(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents to exclude."""
    r = residue(documents)
    whole = (F.col("residue_words") > 0) & (F.col("residue_words") >= SHARE * F.col("content_words"))
    return r.where((F.col("fields") > 0) | F.col("filled_section") | whole).select("doc_id").distinct()
