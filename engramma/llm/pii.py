"""Problem 1: personal information in free text, found and replaced by typed placeholders.

Weak supervision. Broad patterns propose spans of five types; for each span six labelers vote for (1), against (-1) or not
at all (0). They are of three kinds: patterns (strict forms, order, case), gazetteers (given and family names and heads of
other names of the tables, top-level labels, calling codes, check letters, street kinds) and contexts (words before and
after). No test votes twice. Votes are counted over the whole corpus; expectation-maximisation on these counts estimates
each labeler's reliability and a probability for each pattern of votes; a logistic span classifier, trained on these
probabilities as soft labels, has the last word. Both models see the corpus only as counts of votes and shapes, of which
there are at most 3^6 * 224 a type, however large the corpus is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.session import stored

TYPES = ["email", "phone", "national_id", "street_address", "person_name"]
LABELERS = 6
CANDIDATES = "tbl string, rec_id string, turn_key string, pii_type string, start int, stop int, votes string, shape string"
#: Most distinct name tokens that the gazetteers may hold; they go to every worker. More is an error, never a cut.
GAZETTEER_MAX = 1_000_000

# --- email ---------------------------------------------------------------------------------------------------------
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_HOST = rf"[\w-]+(?:{_DOT}[\w-]+)*"
#: The sign of an address: written, in brackets, or as a word before a host that has a dot.
_SIGN = re.compile(rf"\s?@\s?|\s?[\[({{]\s?at\s?[\])}}]\s?|\sat\s(?=[\w-]+{_DOT}[\w-])", re.I)
_LOCAL = re.compile(rf"(?<![\w.+-])[\w+-]+(?:{_DOT}[\w+-]+)*\Z", re.I)
#: No local part is looked for farther back than this; the longest that mail allows is 64, and written-out dots add to it.
_LOCAL_MOST = 256
_DOMAIN = re.compile(_HOST, re.I)
_DOMAIN_SPACED = re.compile(r"[\w-]+(?:\s?\.\s(?=(?-i:[a-z0-9]))[\w-]+|\s\.[\w-]+)+", re.I)
_ENDS_TOP = re.compile(rf".*(?:{_DOT}|\s?\.\s?)[^\W\d_]{{2,}}", re.I | re.S)
_LABEL = re.compile(r"[^\W_]+")
_EMAIL_NEAR = re.compile(r"mail|correo|courriel|write|schreib|écris|escríbe|\bcc\b|invite|newsletter|address|adresse|contact|reach", re.I)
# Top-level labels in wide use or reserved for examples.
_TOP = set("com org net edu gov int info biz name dev app io co me uk de fr es it nl be ch at eu us ca au jp cn in br pt se no fi dk pl example test invalid".split())
# Words before a spelled sign that belong to the sentence.
_NO_LOCAL = set("me us him her them you it i we they is are was were be am look meet see call stay live work arrive photos".split())

# --- numbers -------------------------------------------------------------------------------------------------------
_NUMBER = re.compile(
    r"(?<![\w@./-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)|(?:\+\s?|\()?(?:[A-Za-z]{1,3}(?=\d)|[A-Z]{1,3}-(?=\d))?\(?\d"
    r"(?:[\dA-Z()]|\.(?=\d)|[ /-]{1,3}(?=[\d(])|-(?=[A-Z](?!\w)))*(?:,?\s?(?:ext\.?|x|Durchwahl|poste)\s?\d{1,5})?)(?!@)"
)
_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
_SPOKEN = re.compile(rf"(?<!\w){_WORD}(?:[\s,-]+{_WORD}){{5,}}(?!\w)", re.I)
_PHONE_STRICT = re.compile(
    r"(?:(?:\+1|1)[ .-]?)?(?:\(\d{3}\)\s?|\d{3}[.-])\d{3}[ .-]\d{4}|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}"  # North America
    r"|\+\d{2,3}[ .-]?(?:\(0\)[ .-]?)?\d[\d ./-]{5,14}\d|00\d{2}[ .-](?=(?:\D?\d){7})\d[\d ./-]{5,13}\d"  # international
    r"|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ /]{1,3}\d{3,8}(?:[ -]\d{1,5}){0,2}"  # national with trunk 0
)
# Calling codes of countries; at least seven digits follow.
_CALLING = re.compile(r"(?:\+\s?|00)(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35\d|37\d|38\d|42[013]|85\d|97\d)(?=(?:\D*\d){7})")
_EXT = re.compile(r",?\s?(?:ext\.?|x|Durchwahl|poste)\s?\d{1,5}$", re.I)
_PHONE_NEAR = re.compile(r"\bcall|\btext\b|\btel|phone|number is|\brang\b|\bring|\bruf|appelle|tel[eé]fono|m[oó]vil|mobile|handy|nummer|numéro de téléphone|best number", re.I)
_ID_STRICT = re.compile(
    r"\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{1,3}\d{6,8}|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[CL]\d\w{7}|\d{4}[A-Z]{2}\d{3}|\d{2}[A-Z]{2}\d{5}"
    r"|\d{2} \d{3} \d{3} \d{3}|[A-Z]{2}-\d{3}-\d{4}"
)
_ID_NEAR = re.compile(
    r"\bssn\b|social[ -]security|\bni number|national insurance|passport|pasaporte|passeport|reisepass|licen[cs]e|führerschein|permis de conduire|carnet de conducir"
    r"|\bid card|identity|ausweis|carte d.identité|\bdni\b|\bnie\b|\bnif\b|steuer-?id|steuernummer|sécu\b|sécurité sociale|seguridad social|sozialversicherung|tax (?:id|number|no)|\btin\b|insurance n|personalausweis",
    re.I,
)
#: Words beside numbers that count or label other things.
_OTHER_NEAR = re.compile(
    r"invoice|order|version|track|ticket|serial|coordinates|isbn|\bbook\b|room|rechnung|bestellung|factura|pedido|facture|commande|route|build|page|score|parcel|gauge|model|euros?|kilomet",
    re.I,
)
_ISBN = re.compile(r"97[89][ -]?\d{1,5}[ -]?\d{1,7}[ -]?\d{1,7}[ -]?\d")
#: Check letters of the Spanish identity number.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"

# --- streets -------------------------------------------------------------------------------------------------------
_KIND_EN = r"(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|close|terrace|court|crescent|boulevard|blvd|square|way|row|mews|parade|grove)"
_STREET_EN = re.compile(rf"(?<![\w.,:@/-])(?:(?:flat|apt|unit|suite)\.?\s\w+,?\s)?\d{{1,5}}\s?[a-z]?,?\s(?:[\w'’-]+\s){{1,3}}?{_KIND_EN}(?!\w)\.?", re.I)
_STREET_DE = re.compile(
    r"(?<!\w)(?:[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|chaussee)|[A-ZÄÖÜ][\w-]+(?:er|en)?[ -](?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ufer|Damm|Ring)"
    r"|(?:am|an der|an den|im|auf der|auf dem|zum|zur|beim|hinter der|unter den)\s(?!(?:jan|feb|mär|apr|mai|jun|jul|aug|sep|okt|nov|dez|mon|die|mit|don|fre|sam|son)\w*\s)[A-ZÄÖÜ][\w-]{3,})\s?\d{1,3}\s?[a-z]?(?!\w|[.:]\d|\s(?:euro|minuten|uhr|tage|stunden|kilo|jahre|wochen))",
    re.I,
)
_STREET_FR = re.compile(r"(?<![\w.,:@/-])\d{1,4}\s?(?:bis|ter)?,?\s(?:rue|chemin|impasse|avenue|av\.|boulevard|bd|place|quai|allée|cours|passage|route|sentier)\s(?:(?:de|du|des|la|le|les|l')\s?)*[\w'’-]+(?:[ -](?-i:(?!(?:Nous|Je|Tu|Il|Elle|On|Les?|La|Mon|Ma|Mes|Une?|Quand|Notre|Mais|Et)\b)[A-ZÉÈ][\w-]+))*", re.I)
_STREET_ES = re.compile(
    r"(?<!\w)(?<!\d\s)(?:calle\s|c/\s?|c\.\s(?=de|del|(?-i:[A-ZÁÉÍÓÚÑ]))|avenida\s|avda\b\.?\s?|av\.\s?|plaza\s|pza\b\.?\s?|paseo\s|camino\s|ronda\s|travesía\s|carrera\s)(?:(?:de|del|la|las|los|el)\s)*[\w'’-]+(?:\s(?!nº|n\.º|núm)[^\W\d][\w'’-]+){0,3},?\s(?:nº|n\.º|núm\.?|número)?\s?\d{1,4}(?!\w)", re.I
)
#: Words that no street is called by: what stands between number and kind is a sentence.
_STREET_NOT = re.compile(
    r"\b(?:to|went|of|at|for|in|from|minutes?|hours?|days?|weeks?|years?|euros?|kilomet\w+|percent|things|and|people|times|is|was|we|the|on|my|after|before|with|near|old and|lap|steps?|metres?|points?)\b", re.I
)
_STREET_NEAR = re.compile(r"live|wohn|habite|vivo|moved|deliver|lieferadresse|livraison|entrega|adress|dirección|domicilio|key is|pick (?:me|us) up|from:|flat|apt|schlüssel|clé|llave", re.I)
# Kinds that mean a street and nothing else.
_SURE_KIND = re.compile(r"street|\broad\b|\brd\b|\blane\b|avenue|\bave\b|boulevard|\bblvd\b|crescent|terrace|\bst\b|straße|strasse|str\.|gasse|allee|chaussee|\brue\b|chemin|impasse|calle|avda|avenida|paseo|\bc/", re.I)
_KIND_SAID = re.compile(rf"\b(?:the|a|an|my|our|his|her|this|that)\s{_KIND_EN}\b", re.I)
#: What may follow an address: a sign, the end, a post code, or a town.
_STREET_END = re.compile(r"\s?,|\s?\n|\s?\||\.?\s|\.?$")
_TOWN_NEXT = re.compile(r"(?:\s?,\s?|\s?\n\s?)(?:\d{4,5}\s)?[A-ZÄÖÜÉÁ][\w-]+")

# --- names ---------------------------------------------------------------------------------------------------------
_TITLE = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "doctor", "mme", "mlle", "monsieur", "madame", "herr", "frau", "señor", "señora", "sr", "sra", "srta", "don", "doña", "sir", "senor", "senora", "dona"}
# Heads of the names of places, firms and ensembles; those that the tables use are learned besides.
_PLACE = {
    "street", "st", "road", "rd", "lane", "avenue", "drive", "close", "terrace", "station", "arena", "harbour", "bridge", "forest", "valley", "point", "hill", "lake", "market", "library", "gardens",
    "park", "school", "university", "institute", "hospital", "quartet", "trio", "quintet", "orchestra", "choir", "band", "ensemble", "collective", "gmbh", "ltd", "llc", "inc", "limited", "sons", "brothers",
    "company", "co", "ag", "sa", "foundation", "association", "club", "theatre", "museum", "cup", "prize", "award", "festival", "bakery", "bank", "hall", "chor", "orchester",
}
# Function words, greetings and verbs that open sentences in the languages of the tables; no family names.
_STARTERS = set(
    "i you he she it we they the a an my our your his her their this that these those there here what how why where when who which let could please thanks thank regards cordialement saludos grüße honestly well luckily "
    "actually sadly after before since next no not yes and or but if as at in on by for from to text call ask order all one two three once "
    "der die das ein eine mein meine unser unsere ich wir sie es er hat habe wann wie was wo warum weißt erzähl nächsten ehrlich für im am kommt ruf schreib viele "
    "le la les un une mon ma mes notre nous je tu il elle ils quand comment pourquoi où te franchement écris appelle el los las una mi mis nuestro nuestra yo tú ella cuándo cómo qué por dónde hablamos todavía "
    "cuéntame escríbeme tel flat passport driver deliver entrega livraison lieferadresse dni nie ssn".split()
)
# Fixed words that are given names or nicknames when they begin with a capital, and common words otherwise.
_COMMON_GIVEN = {"will", "bill", "rob", "mark", "art", "may", "june", "joy", "hope", "faith", "grace", "rose", "lily", "ivy", "drew", "chip", "jack", "frank", "peg", "pat", "sue", "nick"}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")
_NAME_NEAR = re.compile(r"name is|is called|ask for|is with|\bmet\b|thanks|regards|from:|grüße|cordialement|saludos|it was|termin ist bei|avec|cita es con|heiß|llam|appelle|name ist|nom est|nombre es|signed|contact|attn|dear", re.I)
_NAME_AFTER = re.compile(r"^(?:[\s,]*(?:will|unterschreibt|signera|firmará|who|wrote|called|said)\b|\s*(?:\||\n|$))", re.I)


def plain(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower()


def _votes(*v: int) -> str:
    return "".join("+" if x > 0 else "-" if x < 0 else "0" for x in v).ljust(LABELERS, "0")


Span = tuple[str, int, int, str, str]


def _proposed(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, sign, end of sign, stop) of everything that has the parts of an address; none reaches into the next one."""
    signs = list(_SIGN.finditer(text))
    floor = 0
    for i, m in enumerate(signs):
        if m.start() < floor:
            continue  # a word of the address before
        head = _LOCAL.search(text, max(floor, m.start() - _LOCAL_MOST), m.start())
        spaced = m.group()[0].isspace() and m.group()[-1].isspace() and "@" in m.group()
        host = spaced and _DOMAIN_SPACED.match(text, m.end()) or _DOMAIN.match(text, m.end())
        if not head or not host:
            continue
        # of "at jo@host" the second sign is meant
        if i + 1 < len(signs) and signs[i + 1].start() <= host.end() and signs[i + 1].start() > m.start() and host.end() <= signs[i + 1].end() and "@" not in m.group():
            continue
        yield head.start(), m.start(), m.end(), host.end()
        floor = host.end()


def _emails(text: str, names: frozenset[str] | set[str] = frozenset()) -> Iterator[Span]:
    for start, at, past, stop in _proposed(text):
        sign, local, host = text[at:past], text[start:at], text[past:stop]
        symbol = "@" in sign
        spelled = not symbol and sign.strip().lower() == "at"
        near = text[max(0, start - 28) : start]
        labels = _LABEL.findall(host)
        spaced_host = symbol and sign != "@" and host[:1].isupper()
        yield "email", start, stop, _votes(
            1 if _ENDS_TOP.fullmatch(host) else -1,
            1 if labels and labels[-1].lower() in _TOP else 0,
            1 if any(plain(w) in names for w in re.findall(r"[^\W\d_]+", local)) or any(c.isdigit() or c in "._+-" for c in local) else 0,
            1 if _EMAIL_NEAR.search(near) else 0,
            1 if sign == "@" else -1 if spaced_host else 0,
            -1 if local.lower() in _NO_LOCAL else 0,
        ), "symbol" if symbol else "spelled" if spelled else "bracket"


def _runs(text: str) -> Iterator[tuple[int, str]]:
    """Runs of digits, letters and signs that may be one number; of two telephone numbers side by side, each."""
    for m in _NUMBER.finditer(text):
        s = m.group().rstrip(" .,-/(")
        gaps = [i for i, c in enumerate(s) if c == " "] if sum(c.isdigit() for c in s) > 15 else []
        at = next((i for i in gaps if _PHONE_STRICT.fullmatch(s[:i]) and _PHONE_STRICT.fullmatch(s[i + 1 :])), None)
        yield from [(m.start(), s)] if at is None else [(m.start(), s[:at]), (m.start() + at + 1, s[at + 1 :])]


def _checked(core: str) -> bool:
    """Whether the check letter of a Spanish number is right."""
    flat = core.replace("-", "").replace(" ", "")
    if not re.fullmatch(r"[XYZ0-9][0-9]{7}[A-Z]", flat):
        return False
    return _DNI[int(flat[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == flat[-1]


def _shape(core: str, digits: int, letters: int) -> str:
    """One of at most 8 * 4 * 7 classes."""
    seps = {c for c in core if not c.isalnum()} - {"+"}
    kind = "" if not seps else seps.pop() if len(seps) == 1 else "m"
    return f"{min(max(digits, 5), 12)}d{min(letters, 3)}l{kind if kind in ' -./(m' else 'o'}"


def _numbers(text: str, spoken: bool) -> Iterator[Span]:
    for m in _SPOKEN.finditer(text) if spoken else ():
        near = text[max(0, m.start() - 30) : m.start()] + " " + text[m.end() : m.end() + 25]
        said = len(re.findall(r"[a-z]+", m.group(), re.I))
        yield "phone", m.start(), m.end(), _votes(1 if said >= 7 else 0, 0, 1 if _PHONE_NEAR.search(near) else 0, -1 if _OTHER_NEAR.search(near) else 0, 0, 1 if re.search(r"\b(?:oh|double|triple)\b|,", m.group(), re.I) else 0), "words"
    for start, s in _runs(text):
        digits = sum(c.isdigit() for c in s)
        if digits < 5 or len(s) < 7:
            continue
        left, right = text[max(0, start - 40) : start], text[start + len(s) : start + len(s) + 22]
        left = re.split(r"\d|[?!]\s|(?<!no)(?<!tel)(?<!tél)(?<!nr)\.\s|\n", left)[-1]  # what stands before another number belongs to that
        right = re.split(r"[.?!|,\n]|\s(?=[A-ZÄÖÜÉ])", right)[0]
        core = _EXT.sub("", s)
        letters = sum(c.isalpha() for c in core)
        id_near, phone_near, other = bool(_ID_NEAR.search(left)), bool(_PHONE_NEAR.search(left + " # " + right)), bool(_OTHER_NEAR.search(left + " # " + right))
        shape = _shape(core, digits, letters)
        stop = start + len(s)
        if letters == 0 and 7 <= digits <= 16:
            yield "phone", start, stop, _votes(
                1 if _PHONE_STRICT.fullmatch(core) else -1, 1 if _CALLING.match(core) or core[0] == "(" else 0, 1 if phone_near else 0, -1 if other else 0,
                -1 if id_near or _ISBN.fullmatch(core) else 0, -1 if core.isdigit() else 0,
            ), shape
        if digits >= 5 and (letters + digits) >= 8:
            yield "national_id", start, stop, _votes(
                1 if _ID_STRICT.fullmatch(core) else 0, 1 if _checked(core) else -1 if _ISBN.fullmatch(core) else 0, 1 if id_near else -1, -1 if other and not id_near else 0,
                -1 if _CALLING.match(core) or core[0] == "(" else 0, -1 if phone_near and not id_near else 0,
            ), shape


STREETS = {"en": _STREET_EN, "de": _STREET_DE, "fr": _STREET_FR, "es": _STREET_ES}


def _streets(text: str, languages: Iterable[str] = tuple(STREETS)) -> Iterator[Span]:
    for lang in languages:
        for m in STREETS[lang].finditer(text):
            s = m.group()
            near = text[max(0, m.start() - 36) : m.start()]
            middle = re.sub(r"^(?:flat|apt|unit|suite)\.?\s\w+,?\s", "", s, flags=re.I) if lang == "en" else s
            yield "street_address", m.start(), m.end(), _votes(
                -1 if lang in ("en", "es") and _STREET_NOT.search(middle) else 1, 1 if re.search(r"\s[A-ZÄÖÜÉ]", s) or re.match(r"[A-ZÄÖÜÉ]", s) else 0, 1 if _STREET_NEAR.search(near) else 0,
                -1 if _KIND_SAID.search(s) else 1 if _SURE_KIND.search(s) else 0, 0 if _STREET_END.match(text, m.end()) else -1, 1 if _TOWN_NEXT.match(text, m.end()) else 0,
            ), lang


class Names:
    """Proposes name spans with the gazetteers of given and family names, and of heads of other names (plain lower case)."""

    def __init__(self, given: frozenset[str], family: frozenset[str], heads: frozenset[str] = frozenset()) -> None:
        self.given, self.family, self.heads = given, family, heads | _PLACE
        self.common = _COMMON_GIVEN
        self.roles: dict[str, str] = {}

    def _role(self, word: str) -> str:
        role = self.roles.get(word)
        if role is None:
            if len(self.roles) > 500_000:
                self.roles.clear()
            role = self.roles[word] = self._role_of(word)
        return role

    def _role_of(self, word: str) -> str:
        p = plain(word)
        parts = p.split("-")
        if p in _TITLE:
            return "t"
        if p in self.given and (p not in self.common or word[:1].isupper()):
            return "g"
        if p in self.family or (len(parts) > 1 and any(x in self.family for x in parts)):
            return "f"
        if len(word) == 1:
            return "i" if word.isupper() else "x"
        return "s" if p in _STARTERS or word.lower() in _STARTERS else "w"

    def find(self, text: str, taken: list[tuple[int, int]]) -> Iterator[Span]:
        words = [(m.group().rstrip("."), m.start(), m.start() + len(m.group().rstrip(".")), m.group().endswith(".")) for m in _TOKEN.finditer(text)]
        roles = [self._role(w[0]) for w in words]
        if "g" not in roles and "t" not in roles and "f" not in roles:
            return
        done: set[int] = set()
        for i, role in enumerate(roles):
            if role not in "gtif" or i in done:
                continue
            for span in self._from(text, words, roles, i):
                a, b, kind = span
                s, e = words[a][1], words[b][2]
                if a in done or any(x < e and s < y for x, y in taken) or text[max(0, s - 1) : s] in ("@", "#", "_") or text[e : e + 1] in ("@", "_"):
                    continue
                named = [j for j in range(a, b + 1) if roles[j] in "fwsg" and not (roles[j] == "g" and kind != "gg")]
                surname = next((j for j in named if roles[j] == "f"), named[0] if named else b)
                r = roles[surname]
                styles = {"U" if len(w) > 1 and w.isupper() else "C" if w[:1].isupper() else "l" for w in (words[j][0] for j in range(a, b + 1)) if len(w) > 1 and plain(w) not in _TITLE}
                after = plain(words[b + 1][0]) if b + 1 < len(words) and text[words[b][2] : words[b + 1][1]].strip() == "" else ""
                before, behind = text[max(0, s - 26) : s], text[e : e + 16]
                yield "person_name", s, e, _votes(
                    1 if r == "f" else 0, 0 if len(styles) == 1 else -1, -1 if kind == "word given" else 1 if any(roles[j] in "gt" for j in range(a, b + 1)) else 0,
                    1 if _NAME_NEAR.search(before) or _NAME_AFTER.match(behind) else 0, -1 if after in self.heads or plain(words[surname][0]) in self.heads else 0, -1 if r in "sg" else 0,
                ), kind
                done.update(range(a, b + 1))
                break

    def _from(self, text: str, words: list, roles: list[str], i: int) -> Iterator[tuple[int, int, str]]:
        n = len(words)

        def gap(j: int) -> str:
            return text[words[j][2] : words[j + 1][1]] if j + 1 < n else "\n"

        def close(j: int) -> bool:
            return gap(j) in (" ", ". ", "  ") and (gap(j) != ". " or roles[j] in "ti")

        def like(j: int) -> bool:
            """A family name, or a capitalised word; after a given name in lower case a family name may be so, too."""
            return j < n and (roles[j] == "f" and (words[j][0][:1].isupper() or words[j - 1][0][:1].islower()) or roles[j] in "ws" and words[j][0][:1].isupper() and len(words[j][0]) > 2)

        def full(a: int, b: int, kind: str) -> tuple[int, int, str]:
            """With a second family name."""
            return (a, b + 1, kind) if b + 1 < n and roles[b] == "f" and roles[b + 1] == "f" and gap(b) in (" ", "-") else (a, b, kind)

        role = roles[i]
        if role == "t":
            j = i + 1
            while j < n and close(j - 1) and roles[j] in "gti":
                j += 1
            if close(j - 1) and like(j):
                yield full(i, j, "title")
        elif role == "g":
            j = i + 1
            while j < n and close(j - 1) and roles[j] == "i":
                j += 1
            if j < n and close(j - 1) and like(j):
                yield full(i, j, "given-family")
            if i + 1 < n and close(i) and roles[i + 1] == "g" and i + 2 < n and close(i + 1) and like(i + 2):
                yield full(i, i + 2, "given-family")
            if i and gap(i - 1) == ", " and like(i - 1):
                yield i - 1, i, "family,given"
            if i and gap(i - 1) == " " and roles[i - 1] == "f" and words[i - 1][0][:1].isupper() == words[i][0][:1].isupper():
                yield i - 1, i, "family given"
            if i and gap(i - 1) == " " and like(i - 1) and roles[i - 1] == "w":
                yield i - 1, i, "word given"
        elif role == "i":
            j = i + 1
            while j < n and close(j - 1) and roles[j] == "i":
                j += 1
            if j < n and close(j - 1) and words[j - 1][3] and like(j) and roles[j] == "f":
                yield full(i, j, "initial")
        elif role == "f":
            if i + 1 < n and gap(i) in (", ", " ") and roles[i + 1] in "gi" and (roles[i + 1] == "g" or words[i + 1][3]):
                yield i, i + 1, "family,given"


_WORDS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_INNER = re.compile(r"['’-]")
_EN = set(_KIND_EN[3:-1].split("|"))
_FR = {"rue", "chemin", "impasse", "avenue", "av", "boulevard", "bd", "place", "quai", "allée", "cours", "passage", "route", "sentier"}
_ES = {"calle", "c", "avenida", "avda", "av", "plaza", "pza", "paseo", "camino", "ronda", "travesía", "carrera"}
_DE = {"am", "an", "im", "auf", "zum", "zur", "beim", "hinter", "unter"}
_DE_ENDS = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring", "steig", "chaussee")
_SAYS = set(_WORD[3:-1].split("|"))
_MEMO_MAX = 500_000


class Finder:
    """Candidate spans of texts. What a word can begin or take part in is looked up once a word, and a pattern runs only
    over texts that hold the words and signs without which it cannot match; :meth:`all_spans` runs them all."""

    NAME, SAID, GIVEN, CAPITAL, AT, EN, DE, FR, ES = (1 << i for i in range(9))
    STREET = EN | DE | FR | ES

    def __init__(self, given: frozenset[str], family: frozenset[str], heads: frozenset[str] = frozenset()) -> None:
        self.names = Names(given, family, heads)
        self.parts_given, self.parts_family = ({p for n in names for p in _INNER.split(n)} for names in (given, family))
        self.memo: dict[str, int] = {}

    def _flags(self, word: str) -> int:
        low, flat = word.lower(), plain(word)
        out = self.NAME * (flat in self.parts_family or flat in _TITLE) + self.GIVEN * (flat in self.parts_given) + self.CAPITAL * word[:1].isupper()
        out += self.SAID * (low in _SAYS) + self.AT * (low == "at")
        out += self.EN * (low in _EN) + self.DE * (low in _DE or low.endswith(_DE_ENDS)) + self.FR * (low in _FR) + self.ES * (low in _ES)
        if len(self.memo) > _MEMO_MAX:
            self.memo.clear()
        self.memo[word] = out
        return out

    def spans(self, text: str) -> list[Span]:
        """The candidate spans of one text: (type, start, stop, votes, shape), at most one a place and type."""
        memo, seen, said, before, beside = self.memo, 0, 0, 0, 0
        for w in _WORDS.findall(text):
            f = memo.get(w)
            if f is None:
                f = self._flags(w)
            if f:
                seen |= f
                if f & 2:
                    said += 1
                if (f | before) & 4 and (f & 12 and before & 12):  # a given name beside another or a capital
                    beside = 1
            before = f
        digits = sum(map(text.count, "0123456789")) if text.isascii() else len(_DIGIT.findall(text))
        langs = [lang for lang, flag in (("en", self.EN), ("de", self.DE), ("fr", self.FR), ("es", self.ES)) if seen & flag] if digits else []
        return self._all(text, "@" in text or bool(seen & self.AT), digits >= 5, said >= 6, langs, bool(seen & self.NAME or beside))

    def all_spans(self, text: str) -> list[Span]:
        """The same with every pattern run over the text."""
        return self._all(text, True, True, True, list(STREETS), True)

    def _all(self, text: str, mail: bool, numbers: bool, spoken: bool, langs: list[str], names: bool) -> list[Span]:
        out: list[Span] = list(_emails(text, self.parts_given)) if mail else []
        taken = [(s, e) for _, s, e, v, _ in out if v[0] == "+"]
        if numbers or spoken:
            out += [c for c in _numbers(text, spoken) if not any(a < c[2] and c[1] < b for a, b in taken)]
        if langs:
            out += _streets(text, langs)
        if names:
            out += self.names.find(text, taken)
        return out


def spans(text: str, names: Names) -> list[Span]:
    """The same for a single text."""
    return Finder(names.given, names.family, names.heads).spans(text)


# --- models --------------------------------------------------------------------------------------------------------
def reliabilities(votes: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over distinct vote patterns with their counts.

    A labeler has one reliability, the share of its votes that are right; that it does not vote says nothing of the case,
    and how common cases are is no evidence for one.
    Returns each labeler's (class, labeler, vote) probabilities, the prior of the two classes, and each pattern's
    probability of being a case. Starts from the majority of votes, smoothed, so that the two classes keep their meaning.
    """
    balance = np.clip(votes.sum(1), -2, 2)
    p = 1 / (1 + np.exp(-2.0 * (balance - 0.25)))
    voted = (votes != 0).T @ count
    for _ in range(rounds):
        weight = np.stack([(1 - p) * count, p * count])
        prior = (weight.sum(1) + 1) / (count.sum() + 2)
        right = np.clip(((votes == 1).T @ weight[1] + (votes == -1).T @ weight[0] + 4) / (voted + 5), 0.5, 0.999)
        odds = np.log(right / (1 - right))
        p = 1 / (1 + np.exp(np.clip(-votes @ odds, -40, 40)))
    cover = voted / count.sum()
    wrong = 1 - right
    theta = np.stack([np.stack([right * cover, 1 - cover, wrong * cover], 1), np.stack([wrong * cover, 1 - cover, right * cover], 1)])
    return theta, prior, p


def train_classifier(rows: list[tuple[str, str, str, int]], soft: dict[tuple[str, str], float], steps: int = 400) -> dict[tuple[str, str, str], float]:
    """The span classifier: logistic regression on votes and shape, one model a type, over counted patterns.

    ``rows``: (type, votes, shape, count). Returns the probability of each (type, votes, shape).
    """
    out: dict[tuple[str, str, str], float] = {}
    for t in TYPES:
        own = [r for r in rows if r[0] == t]
        if not own:
            continue
        shapes = {s: i for i, s in enumerate(sorted({r[2] for r in own}))}
        v = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in r[1]] for r in own])
        x = np.concatenate([v == 1, v == -1, np.eye(len(shapes))[[shapes[r[2]] for r in own]] * 0.5, np.ones((len(own), 1))], 1).astype(float)
        y, w = np.array([soft[r[0], r[1]] for r in own]), np.log1p(np.array([r[3] for r in own], float))
        beta = np.zeros(x.shape[1])
        ridge = 0.02 * w.sum() / len(own)
        for _ in range(steps // 20):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (w * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(x.shape[1])
            beta -= np.linalg.solve(h, x.T @ (w * (p - y)) + ridge * beta)
        for r, p1 in zip(own, 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), strict=True):
            out[r[0], r[1], r[2]] = float(p1)
    return out


# --- tables --------------------------------------------------------------------------------------------------------
Gazetteers = tuple[frozenset[str], frozenset[str], frozenset[str]]


def gazetteers(codebook: DataFrame, entity: DataFrame) -> Gazetteers:
    """Given names (of speakers and persons), family names (of persons) and heads of the names of places, firms and products,
    all plain; each is counted before it is fetched."""
    spoken = codebook.select(F.explode(F.split("speakers", r"\s+")).alias("w")).where("w <> ''").distinct()
    spaced = F.split(F.trim(F.regexp_replace("name", r"[.,\s]+", " ")), " ")
    person = entity.where("etype = 'person' and name is not null").select(F.regexp_replace("name", "[.]", " ").alias("name")).distinct()
    given = {plain(w) for (w,) in _bounded(spoken)} - {"user", "assistant", "system"}
    # the words beside a given name are family names, and those beside a family name are given names of another form
    pairs = person.select(F.split(F.trim("name"), r"[\s,]+").alias("w")).where("size(w) between 2 and 4").select(F.col("w")[0].alias("a"), F.element_at("w", -1).alias("b"))
    ends = [(plain(a), plain(b)) for a, b in _bounded(pairs.distinct())]
    family = {y for a, b in ends for x, y in ((a, b), (b, a)) if x in given and y not in given and len(y) > 2}
    given |= {x for a, b in ends for x, y in ((a, b), (b, a)) if y in family and x not in family and len(x) > 3 and x.isalpha() and x not in _TITLE | _STARTERS | {"coach", "boss", "leader"}}
    family = {x for w in family for x in {w, *w.split("-")} if x.isalpha() and x not in given and x not in _TITLE}
    other = entity.where("etype rlike '^(place|org|product)' and name is not null").select(F.filter(spaced, lambda w: ~w.rlike(r"\d")).alias("w")).where("size(w) > 1").select(F.element_at("w", -1).alias("w")).distinct()
    heads = {plain(w) for (w,) in _bounded(other)}
    return frozenset(given), frozenset(family), frozenset(w for w in heads if w.isalpha() and len(w) > 2 and w not in family and w not in given)


def _bounded(df: DataFrame) -> list:
    rows = df.limit(GAZETTEER_MAX + 1).collect()
    if len(rows) > GAZETTEER_MAX:
        raise ValueError(f"more than {GAZETTEER_MAX} names; give gazetteers of a known size")
    return rows


def candidates(texts: DataFrame, known: Gazetteers) -> DataFrame:
    """Candidate spans of (tbl, rec_id, turn_key, text), with votes; null and empty texts have none."""

    shared = texts.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*shared.value)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            keys = [batch.column(i).to_pylist() for i in range(3)]
            for row, text in enumerate(batch.column(3).to_pylist()):
                for t, s, e, v, shape in finder.spans(text):
                    for c, x in zip(cols, (keys[0][row], keys[1][row], keys[2][row], t, s, e, v, shape), strict=True):
                        c.append(x)
            types = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["tbl", "rec_id", "turn_key", "pii_type", "start", "stop", "votes", "shape"])

    return texts.where("text is not null and text <> ''").select("tbl", "rec_id", "turn_key", "text").mapInArrow(scan, CANDIDATES)


def judged(spark: SparkSession, found: DataFrame) -> DataFrame:
    """The candidates that the classifier takes for cases. Only counts of vote and shape patterns come to the driver."""
    counts = [(r["pii_type"], r["votes"], r["shape"], r["n"]) for r in found.groupBy("pii_type", "votes", "shape").agg(F.count("*").alias("n")).collect()]
    soft: dict[tuple[str, str], float] = {}
    for t in TYPES:
        total: dict[str, int] = {}
        for kind, v, _, n in counts:
            if kind == t:
                total[v] = total.get(v, 0) + n
        if total:
            pats = sorted(total)
            votes = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in v] for v in pats])
            _, _, p = reliabilities(votes, np.array([total[v] for v in pats], float))
            soft |= {(t, v): float(x) for v, x in zip(pats, p, strict=True)}
    model = train_classifier(counts, soft)
    good = [k for k, p in model.items() if p >= 0.5]
    if not good:
        return found.limit(0)
    keys = spark.createDataFrame(sorted(good), "pii_type string, votes string, shape string")
    return found.join(F.broadcast(keys), ["pii_type", "votes", "shape"], "left_semi")


def find_pii(spark: SparkSession, texts: DataFrame, known: Gazetteers) -> DataFrame:
    """Spans of personal information: (tbl, rec_id, turn_key, pii_type, start, stop), offsets in code points.

    Null, empty and blank texts have none; repeated rows give repeated spans; an empty table gives an empty result.
    """
    found = stored(candidates(texts, known), "pii")
    return judged(spark, found).select("tbl", "rec_id", "turn_key", "pii_type", "start", "stop")


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its placeholder; of overlapping spans the earliest, then longest stands."""
    out, at = [], 0
    for s, e, t in sorted(found, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"[{t.upper()}]"]
            at = e
    return "".join([*out, text[at:]])


def redacted(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(tbl, rec_id, turn_key, text): every utterance with typed placeholders, all else unchanged; null text stays null.

    Repeated rows of one key carry one text and come out once.
    """
    marks = found.distinct().groupBy("tbl", "rec_id", "turn_key").agg(F.collect_list(F.struct("start", "stop", "pii_type")).alias("marks"))
    both = texts.select("tbl", "rec_id", "turn_key", "text").distinct().join(marks, ["tbl", "rec_id", "turn_key"], "left")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [x if not m or x is None else redact(x, [(k["start"], k["stop"], k["pii_type"]) for k in m]) for x, m in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(text, pa.string())], names=["tbl", "rec_id", "turn_key", "text"])

    return both.mapInArrow(fill, "tbl string, rec_id string, turn_key string, text string")
