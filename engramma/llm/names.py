"""Problem 5: the spellings that mean the same person or organisation, linked.

Every string of a codebook (entity code or undeclared label) has forms: itself, and for codes their names and aliases.
A form is reduced to plain tokens (case, accents, look-alike letters, digits for letters, joined words, legal forms,
titles and usual abbreviations taken out). Candidates come from a prefix-filtered set-similarity join on the q-grams of
rare tokens within a codebook; a pair of forms is verified by soft token similarity weighted by how rare the tokens are
in all codebooks. Full forms make groups; a partial form (an initial or a title with a family name, an acronym, the
first words of a firm) joins a group only if it fits no other one in its codebook.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramma.llm.plaintext import INVISIBLE, LOOKALIKES
from engramma.session import cut, stored

#: Least Jaccard similarity of the q-grams of two tokens.
JACCARD = 0.3
Q = 2
#: Least weighted similarity of two full forms.
SAME = 0.8
LEXICON_MAX = 1_000_000

# Fixed values.
TITLES = {"dr", "prof", "professor", "doctor", "mr", "mrs", "ms", "miss", "mme", "mlle", "m", "herr", "frau", "sir", "coach", "captain", "señor", "señora", "senor", "senora", "sr", "sra", "uncle", "aunt", "judge", "nurse", "pastor", "chef"}
LEGAL = {"gmbh", "llc", "inc", "ltd", "limited", "ag", "corp", "corporation", "plc", "co", "company", "kg", "group", "holding", "incorporated", "ev", "sa", "bv", "srl", "spa", "oy", "ab", "pty"}
SHORT = {
    "assoc": "association", "assn": "association", "dept": "department", "labs": "laboratories", "lab": "laboratories", "mfg": "manufacturing", "univ": "university", "uni": "university", "inst": "institute",
    "found": "foundation", "fdn": "foundation", "intl": "international", "int": "international", "bros": "brothers", "svcs": "services", "svc": "services", "serv": "services", "coop": "cooperative", "log": "logistics",
    "mgmt": "management", "tech": "technology", "natl": "national", "ctr": "center", "sav": "savings", "hosp": "hospital",
}
ORG_WORDS = {
    "association", "department", "store", "laboratories", "manufacturing", "university", "institute", "foundation", "international", "brothers", "services", "cooperative", "logistics", "club", "society", "school",
    "hospital", "bank", "savings", "trust", "studio", "theatre", "press", "partners", "solutions", "systems", "works", "college", "academy", "union", "council", "agency", "clinic",
}
PLACE_WORDS = {"station", "bridge", "lake", "valley", "harbour", "arena", "market", "gardens", "hill", "point", "library", "forest", "square", "park", "beach", "museum", "airport", "castle"}
_DIGIT_LETTERS = str.maketrans("013457", "oleast")
_PART = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])")
_UMLAUT = re.compile(r"(?<=[aou])e")
_ROLE = re.compile(r"^(?:the|my|our|his|her|your|der|die|das|mein|meine|le|la|el)\b", re.I)


def tokens(text: str) -> list[str]:
    """Plain tokens in their order; a full stop or not after a token makes no difference."""
    t = text.translate(INVISIBLE)
    if any("Ͱ" <= c <= "ӿ" for c in t):
        t = t.translate(LOOKALIKES)
    t = _CAMEL.sub(" ", t)
    t = unicodedata.normalize("NFKD", t)
    t = "".join(c for c in t if not unicodedata.combining(c)).casefold().replace("'", "").replace("’", "")
    t = re.sub(r"\be\.\s?v\b\.?|(?<=_)e_v$", "ev", re.sub(r"\bs\.\s?a\b\.?|(?<=_)s_a$", "sa", t)).replace("co-op", "coop").replace("co_op", "coop")
    out = []
    for w in _PART.findall(t):
        if any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
            w = w.translate(_DIGIT_LETTERS)
        out.append(SHORT.get(w, w))
    return out


class Lexicon:
    """Given names and their other forms, with an index of what is left of them without a letter or two, so that what is
    like a name is found without going through all."""

    def __init__(self, known: frozenset[str] = frozenset()) -> None:
        self.known = known
        self.starts = {g[:3] for g in known}
        self.near: dict[str, list[str]] = {}
        for g in known:
            for key in {*_shortened(g), "~" + _UMLAUT.sub("", g)}:
                self.near.setdefault(key, []).append(g)

    def __contains__(self, token: str) -> bool:
        return token in self.known

    def like(self, token: str) -> bool:
        """Whether a token is a name, a misspelt one, or the first three letters of one."""
        if token in self.known or len(token) == 3 and token in self.starts:
            return True
        return any(abs(len(token) - len(g)) <= 2 and token_similarity(token, g) > 0 for key in {*_shortened(token), "~" + _UMLAUT.sub("", token)} for g in self.near.get(key, ()))

    def joined(self, token: str) -> tuple[str, str] | None:
        """(name, rest) of a word that a name of three letters or more begins or ends, four letters or more being left."""
        for n in range(len(token) - 4, 2, -1):
            if token[:n] in self.known:
                return token[:n], token[n:]
            if token[-n:] in self.known:
                return token[-n:], token[:-n]
        return None


def _shortened(token: str) -> set[str]:
    """A token without up to as many letters as a misspelling of it may change."""
    out = {token}
    if len(token) >= 3:
        out |= {token[:i] + token[i + 1 :] for i in range(len(token))}
    if len(token) >= 5:
        out |= {t[:i] + t[i + 1 :] for t in list(out) for i in range(len(t))}
    return out


@lru_cache(2)
def _lexicon(known: frozenset[str]) -> Lexicon:
    return Lexicon(known)


def parse(text: str | None, etype: str | None, known: Lexicon | None = None) -> tuple[str, list[str], str, str]:
    """(class, tokens, initials, shape) of a form; ``known`` has the given names and their other forms.

    class: person, org or none (places, products, role words, blanks). shape: full, initial, title, acronym, part, single.
    """
    nothing = ("none", [], "", "none")
    known = known or Lexicon()
    if text is None or not text.strip():
        return nothing
    kind = (etype or "").split(".")[0]
    toks = tokens(text)
    if kind in ("place", "product") or not toks or _ROLE.match(text) and not text.startswith("The. ") and not any(t in ORG_WORDS for t in toks):
        return nothing
    legal = len(toks) > 1 and toks[-1] in LEGAL
    worded = any(_org_word(t) for t in toks)
    if kind != "org" and not legal and not worded and (toks[-1].isdigit() or toks[-1] in PLACE_WORDS and (len(toks) != 2 or kind)):
        return nothing
    if toks[0] == "the" and (len(toks) > 2 or len(toks) == 2 and (legal or worded)):
        toks = toks[1:]
    if len(toks) == 1 and kind != "person" and 3 <= len(toks[0]) <= 4 and toks[0].isalpha() and toks[0] not in known:
        return "org", toks, "", "acronym"
    if kind == "org" or (kind != "person" and (legal or worded)):
        core = list(toks)
        while len(core) > 1 and core[-1] in LEGAL:
            core.pop()
        core = [t for t in core if t not in ("and", "of", "for")]
        if len(core) < 2:
            return "org", core, "", "full" if core and len(core[0]) >= 14 else "single"
        return "org", core, "", "full" if len(core) > 2 or any(_org_word(t) for t in core) else "part"
    title = False
    core, initials = [], ""
    for i, t in enumerate(toks):
        if t in TITLES and len(toks) > 1 and len(t) > 1 and i in (0, len(toks) - 1):
            title = True
        elif len(t) == 1:
            initials += t
        else:
            core.append(t)
    if not core:
        return nothing
    if len(core) == 1 and not initials and not title:
        one = core[0]
        if (both := known.joined(one)) is None:
            return "person", core, "", "single"
        core = list(both)
    if len(core) == 1:
        return "person", core, initials, "initial" if initials else "title"
    if len(core) == 2 and not kind and not initials and not title and not any(known.like(t) for t in core):
        return "org", core, "", "part"  # the first words of a firm, or a place
    return "person", core, initials, "full"


@lru_cache(50_000)
def _org_word(t: str) -> bool:
    return t in ORG_WORDS or (len(t) > 6 and any(abs(len(t) - len(o)) <= 2 and edits(t, o, 2) <= (1 if len(o) < 9 else 2) for o in ORG_WORDS if len(o) > 6))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or ``most`` + 1 where it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


@lru_cache(500_000)
def token_similarity(a: str, b: str) -> float:
    """1 for equal tokens, less for each edit, 0 beyond one edit (two in long tokens)."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    if n > 4 and _UMLAUT.sub("", a) == _UMLAUT.sub("", b):
        return 0.98
    most = 0 if n < 4 else 1 if n < 7 else 2
    d = edits(a, b, most)
    return 0.0 if d > most else 1 - 0.9 * d / n


class Verifier:
    """Soft weighted token similarity; ``nick`` has (given name, other form of it) pairs."""

    def __init__(self, nick: frozenset[tuple[str, str]], given: frozenset[str]) -> None:
        self.nick, self.given = nick, given

    def alike(self, a: str, b: str) -> float:
        s = token_similarity(a, b)
        if s:
            # two different given names are no misspellings of each other
            return 0.0 if s < 1 and a in self.given and b in self.given and (a, b) not in self.nick and (b, a) not in self.nick else s
        if (a, b) in self.nick or (b, a) in self.nick:
            return 0.97
        short, long = sorted((a, b), key=len)
        return 0.9 if len(short) == 3 and len(long) >= 5 and long.startswith(short) else 0.0

    def similarity(self, a: list[str], b: list[str], wa: list[float], wb: list[float], person: bool) -> float:
        """Matched weight over all weight, order aside; joined words are compared as one."""
        if len(a) == 1 or len(b) == 1:
            (one, many) = (a, b) if len(a) == 1 else (b, a)
            if len(many) == 1:
                return token_similarity(one[0], many[0])
            orders = ["".join(many), "".join(many[1:] + many[:1])]
            return max(token_similarity(one[0], o) for o in orders)
        free = set(range(len(b)))
        total, got = sum(wa) + sum(wb), 0.0
        for s, i, j in sorted(((self.alike(x, y) if person else token_similarity(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True):
            if s and i is not None and j in free and wa[i] >= 0:
                got += s * (wa[i] + wb[j])
                free.discard(j)
                wa = [*wa[:i], -1.0, *wa[i + 1 :]]
        # words left over on both sides tell two names apart, however common these words are
        return 0.0 if free and max(wa) >= 0 else got / total if total else 0.0

    def partial(self, part: tuple[list[str], str, str], full: list[str], person: bool) -> bool:
        """Whether a partial form (tokens, initials, shape) fits a full one."""
        toks, initials, shape = part
        if shape == "acronym":
            return len(full) >= 3 and toks[0] == "".join(t[0] for t in full)
        if shape == "part":
            return not person and len(toks) >= 2 and len(full) > len(toks) and all(token_similarity(x, y) > 0 for x, y in zip(toks, full, strict=False))
        if not person or len(full) < 2:
            return False
        only_given = all(t in self.given for t in full)  # then each may be the family name
        for i, t in enumerate(full):
            if token_similarity(toks[0], t) > 0 and (only_given or t not in self.given):
                others = [x for j, x in enumerate(full) if j != i]
                firsts = {x[0] for x in others} | {g[0] for g, n in self.nick if n in others}
                if shape == "title" or initials[0] in firsts:
                    return True
        return False


FORMS = "g string, node string, src string, kind string, toks array<string>, initials string, shape string"


def forms(entity: DataFrame, fact: DataFrame, known: frozenset[str]) -> DataFrame:
    """The parsed forms of all strings: (g, node, src, kind, toks, initials, shape)."""
    e = entity.where("codebook_id is not null and code is not null").select(F.col("codebook_id").alias("g"), F.col("code").alias("node"), "etype", "name", "aliases").distinct()
    # a code of which some row says place or product is one
    typed = e.groupBy("g", "node").agg(F.max(F.when(F.col("etype").rlike("^(place|product)"), F.col("etype"))).alias("not_named"), F.max("etype").alias("etype"))
    typed = typed.select("g", "node", F.coalesce("not_named", "etype").alias("etype"))
    own = typed.select("g", "node", "etype", F.col("node").alias("text"), F.lit("self").alias("src"))
    rows = e.drop("etype").join(typed, ["g", "node"])
    name = rows.select("g", "node", "etype", F.col("name").alias("text"), F.lit("name").alias("src"))
    alias = rows.select("g", "node", "etype", F.explode("aliases").alias("text"), F.lit("alias").alias("src"))
    declared = own.unionByName(name).unionByName(alias)
    said = fact.where("codebook_id is not null").select(F.col("codebook_id").alias("g"), F.explode("entities").alias("node")).where("node is not null").distinct()
    labels = said.join(own.select("g", "node"), ["g", "node"], "left_anti").select("g", "node", F.lit(None).cast("string").alias("etype"), F.col("node").alias("text"), F.lit("self").alias("src"))

    shared = entity.sparkSession.sparkContext.broadcast(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(shared.value)
        for b in batches:
            got = [parse(t, k, lexicon) for t, k in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.list_(pa.string())), pa.array([x[2] for x in got], pa.string()), pa.array([x[3] for x in got], pa.string())],
                names=["g", "node", "src", "kind", "toks", "initials", "shape"],
            )

    both = declared.unionByName(labels).select("g", "node", "src", "text", "etype").where("text is not null").distinct()
    return both.mapInArrow(read, FORMS).where("kind <> 'none' and shape not in ('none', 'single')").distinct()


def lexicons(spark: SparkSession, codebook: DataFrame, entity: DataFrame) -> tuple[frozenset[tuple[str, str]], frozenset[str]]:
    """(nickname pairs, given names), learned from all codebooks and counted before they are fetched.

    A word is another form of a given name if it stands for it as an alias (alone, or before the same family name) in two
    codebooks at least and in a quarter of its uses; role words stand for everyone and fall out.
    """
    speakers = codebook.select(F.explode(F.split("speakers", r"\s+")).alias("w")).where("w <> ''").distinct()
    given = {"".join(tokens(r["w"])) for r in _bounded(speakers)} - {"user", "assistant", "system"}
    people = entity.where("etype = 'person' and name is not null and aliases is not null").select("codebook_id", "name", F.explode("aliases").alias("alias")).where("alias is not null").distinct()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for g, name, alias in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if _ROLE.match(alias):
                    continue
                full, other = [t for t in tokens(name) if len(t) > 1 and t not in TITLES], [t for t in tokens(alias) if len(t) > 1]
                first = next((t for t in full if t in given), None)
                rest = [t for t in full if t != first]
                new = [t for t in other if not any(token_similarity(t, r) for r in rest)]
                if first and len(full) == 2 and len(new) == 1 and len(other) <= 2 and (len(other) == 1 or len(new) < len(other)) and not token_similarity(new[0], first) and new[0] not in TITLES:
                    rows.append((g, first, new[0]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["g", "given", "nick"])

    seen = people.mapInArrow(pairs, "g string, given string, nick string").groupBy("given", "nick").agg(F.countDistinct("g").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("nick"))
    learned = _bounded(seen.withColumn("share", share).where((F.col("n") >= 2) & (F.col("share") >= 0.25)).select("given", "nick"))
    return frozenset((r["given"], r["nick"]) for r in learned), frozenset(given)


def _bounded(df: DataFrame) -> list:
    rows = df.limit(LEXICON_MAX + 1).collect()
    if len(rows) > LEXICON_MAX:
        raise ValueError(f"more than {LEXICON_MAX} words in a name lexicon")
    return rows


def similar_tokens(rare: DataFrame) -> DataFrame:
    """(g, a, b): the pairs of tokens of one codebook whose q-grams are alike, equal ones too but for common ones; from
    (g, token, common), distinct; without the column none is common.

    Prefix filter: with its grams in order of their frequency, a token shares one of its first |S| - ceil(JACCARD |S|) + 1
    grams with every token that is so similar. Of two common tokens nothing is asked.
    """
    rare = rare if "common" in rare.columns else rare.withColumn("common", F.lit(False))
    padded = F.concat(F.lit("^"), "token", F.lit("$"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") + 3 - Q), lambda i: F.substring(padded, i, Q)))
    sets = rare.withColumn("grams", grams)
    frequency = sets.select(F.explode("grams").alias("gram")).groupBy("gram").count()
    ranked = sets.select("g", "token", "common", F.explode("grams").alias("gram"), F.size("grams").alias("n")).join(frequency, "gram")
    order = W.partitionBy("g", "token").orderBy("count", "gram")
    prefix = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("n") - F.ceil(F.lit(JACCARD) * F.col("n")) + 1).select("g", "gram", "token", "n", "common")
    # length filter: sets of very different size cannot be so similar
    a, b = prefix.toDF("g", "gram", "a", "na", "ca"), prefix.toDF("g", "gram", "b", "nb", "cb")
    pairs = a.join(b, ["g", "gram"]).where((F.col("a") < F.col("b")) & ~(F.col("ca") & F.col("cb")) & (F.col("na") >= JACCARD * F.col("nb")) & (F.col("nb") >= JACCARD * F.col("na"))).select("g", "a", "b").distinct()
    near = pairs.where(F.levenshtein("a", "b") <= 3)
    joined = pairs.where((F.length("a") >= 10) & F.col("a").contains(F.col("b")) | (F.length("b") >= 10) & F.col("b").contains(F.col("a")))
    both = near.unionByName(joined).distinct()
    return both.unionByName(both.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(rare.where("not common").select("g", F.col("token").alias("a"), F.col("token").alias("b")))


def link_names(spark: SparkSession, codebook: DataFrame, entity: DataFrame, fact: DataFrame) -> DataFrame:
    """(codebook_id, name_a, name_b): the pairs of strings that mean the same person or organisation, name_a the smaller.

    Null and blank strings, places, products and role words have none; repeated rows change nothing; empty tables give an
    empty result.
    """
    nick, given = lexicons(spark, codebook, entity)
    known = given | {n for _, n in nick}
    member = stored(forms(entity, fact, frozenset(known)).withColumn("fid", F.xxhash64("kind", F.array_join("toks", " "), "initials", "shape")), "forms")
    f = _weighed(member.select("g", "fid", "kind", "shape", "toks", "initials").dropDuplicates(["g", "fid"]), member)
    member = member.select("g", "node", "fid", "src", "shape").distinct()
    pairs = stored(_candidates(f, spark.createDataFrame([(w,) for w in sorted(known | ORG_WORDS)], "token string")), "name-pairs")
    links = stored(_verified(spark, f, pairs, nick, given), "name-links")

    # full forms that are alike, or of one string, make groups
    full = member.where("shape = 'full'").select("g", "node", "fid")
    own = full.groupBy("g", "node").agg(F.min("fid").alias("a"), F.collect_set("fid").alias("fids")).select("g", "a", F.explode("fids").alias("b")).where("a <> b")
    root = components(full.select("g", F.col("fid").alias("node")), links.where("verdict = 'same'").select("g", "a", "b").unionByName(own)).select("g", F.col("node").alias("fid"), "root")
    groups = cut(full.join(root, ["g", "fid"]).groupBy("g", "node").agg(F.min("root").alias("root")))

    # a string with partial forms only joins the only group that they fit; the most telling form decides
    partial = member.join(groups.select("g", "node"), ["g", "node"], "left_anti")
    rank = F.when(F.col("shape") == "initial", 0).when(F.col("shape").isin("acronym", "part"), 1).otherwise(2)
    fits = links.where("verdict = 'part'").select("g", F.col("a").alias("fid"), F.col("b")).join(root.withColumnRenamed("fid", "b"), ["g", "b"]).select("g", "fid", "root").distinct()
    tried = partial.join(fits, ["g", "fid"]).select("g", "node", "root", rank.alias("rank")).distinct()
    best = cut(tried.withColumn("least", F.min("rank").over(W.partitionBy("g", "node"))).where("rank = least").groupBy("g", "node").agg(F.min("root").alias("root"), F.countDistinct("root").alias("n")))
    # where it fits several groups, the only one of them that declares it as an alias is meant
    told = member.where("src = 'alias' and shape <> 'full'").join(groups, ["g", "node"]).groupBy("g", "fid").agg(F.min("root").alias("root"), F.countDistinct("root").alias("n")).where("n = 1").drop("n")
    several = partial.where("src <> 'alias'").join(best.where("n > 1").select("g", "node"), ["g", "node"], "left_semi").join(told, ["g", "fid"]).groupBy("g", "node").agg(F.min("root").alias("root"), F.countDistinct("root").alias("n")).where("n = 1").drop("n")
    alone = cut(best.where("n = 1").drop("n").unionByName(several))

    # what fits no group is linked to what is written alike
    rest = cut(partial.join(alone.select("g", "node"), ["g", "node"], "left_anti").select("g", "node", "fid").distinct())
    loose = rest.groupBy("g", "node").agg(F.min("fid").alias("a"), F.collect_set("fid").alias("fids")).select("g", "a", F.explode("fids").alias("b")).where("a <> b")
    forms_left = rest.select("g", F.col("fid").alias("node")).distinct()
    twins = links.where("verdict = 'twin'").select("g", "a", "b").join(forms_left.withColumnRenamed("node", "a"), ["g", "a"], "left_semi").join(forms_left.withColumnRenamed("node", "b"), ["g", "b"], "left_semi")
    spare = components(forms_left, twins.unionByName(loose)).select("g", F.col("node").alias("fid"), "root")
    spare = rest.join(spare, ["g", "fid"]).groupBy("g", "node").agg(F.min("root").alias("root"))

    whole = cut(groups.select("g", "node", F.concat(F.lit("="), "root").alias("root")).unionByName(alone.select("g", "node", F.concat(F.lit("="), "root").alias("root"))).unionByName(spare.select("g", "node", F.concat(F.lit("~"), "root").alias("root"))))
    a, b = whole.toDF("g", "name_a", "root"), whole.toDF("g", "name_b", "root")
    return a.join(b, ["g", "root"]).where("name_a < name_b").select(F.col("g").alias("codebook_id"), "name_a", "name_b").distinct()


def _weighed(f: DataFrame, member: DataFrame) -> DataFrame:
    """Forms with the weights of their tokens: the fewer strings of all codebooks have a token, the more it weighs."""
    total = member.select("g", "node").distinct().count()
    weights = member.select(F.explode("toks").alias("token"), "g", "node").distinct().groupBy("token").agg(F.log(1 + F.lit(float(total)) / F.count("*")).alias("w"))
    each = f.select("g", "fid", F.posexplode("toks").alias("i", "token")).join(weights, "token").groupBy("g", "fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("ws"))
    return cut(f.join(each, ["g", "fid"]))


def _candidates(f: DataFrame, common: DataFrame) -> DataFrame:
    """(g, a, b): the pairs of forms with alike rare tokens, and acronyms with the names that they spell.

    A form of common words only (given names, words of firms, tokens of two letters or less) has no rare token. It meets
    misspelt ones through all its tokens, and its like through pairs of tokens, and of a token and an initial.
    """
    each = f.where("shape <> 'acronym'").select("g", "fid", "kind", "shape", "toks", "initials", F.explode(F.array_distinct("toks")).alias("token"))
    marked = each.join(common.withColumn("listed", F.lit(True)), "token", "left").withColumn("common", F.col("listed").isNotNull() | (F.length("token") <= 2)).drop("listed")
    bare = F.bool_and("common").over(W.partitionBy("g", "fid"))
    rare = stored(marked.withColumn("bare", bare).where("not common or bare"), "name-tokens")  # plans end where they are used again
    near = stored(similar_tokens(rare.groupBy("g", "token").agg(F.bool_and("common").alias("common"))), "alike-tokens")
    left, right = (rare.select("g", "fid", "kind", "shape", "token").toDF("g", f"f{s}", "kind", f"s{s}", s) for s in ("a", "b"))
    useful = "fa <> fb and (sa = sb and fa < fb or sa <> 'full' and sb = 'full')"
    pairs = left.join(near, ["g", "a"]).join(right, ["g", "b", "kind"]).where(useful).select("g", F.col("fa").alias("a"), F.col("fb").alias("b"))
    # forms of one set of tokens whatever they were taken for, and bare ones by two of their tokens or a token and an initial
    row = "g", "fid", "shape"
    first = lambda x: F.substring(x, 1, 1)
    keys = f.where("shape <> 'acronym' and size(toks) > 1").select(*row, F.concat_ws(" ", F.lit("="), F.array_join(F.array_sort("toks"), " ")).alias("key"))
    plain = rare.where("bare").select(*row, F.col("token").alias("t"), "toks", "initials")
    one = plain.where("shape in ('initial', 'title')").select(*row, F.when(F.col("shape") == "title", F.concat_ws(" ", F.lit("*"), "t")).otherwise(F.concat_ws(" ", F.lit("."), "t", first("initials"))).alias("key"))
    other = plain.where("size(toks) > 1").select(*row, "t", F.explode("toks").alias("o")).where("t <> o")
    made = F.array(F.when(F.col("t") < F.col("o"), F.concat_ws(" ", F.lit("+"), "t", "o")), F.concat_ws(" ", F.lit("."), "t", first("o")), F.concat_ws(" ", F.lit("*"), "t"))
    keys = keys.unionByName(one).unionByName(other.select(*row, F.explode(made).alias("key")).where("key is not null")).distinct()
    x, y = (keys.toDF("g", f"f{s}", f"s{s}", "key") for s in ("a", "b"))
    # full forms that share but a token, or a token and an initial, are no candidates
    pairs = pairs.unionByName(x.join(y, ["g", "key"]).where(useful).where("substr(key, 1, 1) in ('=', '+') or sa <> 'full'").select("g", F.col("fa").alias("a"), F.col("fb").alias("b"))).distinct()
    acronyms = f.where("shape = 'acronym'").select("g", F.col("toks")[0].alias("key"), F.col("fid").alias("a"))
    letters = F.array_join(F.transform("toks", lambda t: F.substring(t, 1, 1)), "")
    spelled = f.where("kind = 'org' and shape = 'full' and size(toks) > 2").select("g", letters.alias("key"), F.col("fid").alias("b"))
    return pairs.unionByName(acronyms.join(spelled, ["g", "key"]).select("g", "a", "b"))


def _verified(spark: SparkSession, f: DataFrame, pairs: DataFrame, nick: frozenset, given: frozenset) -> DataFrame:
    """(g, a, b, verdict): same (two full forms), part (a partial form fits a full one) or twin (two alike partial ones)."""
    shared = spark.sparkContext.broadcast((nick, given))
    side = lambda s: f.select("g", F.col("fid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("kind", "shape", "toks", "initials", "ws")])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Verifier(*shared.value)
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            columns = [at[n].to_pylist() for n in ("kind_b", "shape_a", "shape_b", "toks_a", "toks_b", "initials_a", "initials_b", "ws_a", "ws_b")]
            out = []
            for kind, sa, sb, ta, tb, ia, ib, wa, wb in zip(*columns, strict=True):
                person = kind == "person"
                if sa == sb == "full":
                    clash = person and ia and ib and ia[0] != ib[0]
                    out.append("same" if not clash and v.similarity(ta, tb, wa, wb, person) >= SAME else None)
                elif sb == "full":
                    out.append("part" if sorted(ta) == sorted(tb) and len(ta) > 1 or v.partial((ta, ia, sa), tb, person) else None)
                else:
                    alike = sa == sb != "acronym" and ia[:1] == ib[:1] and len(ta) == len(tb) and all(token_similarity(x, y) for x, y in zip(ta, tb, strict=True))
                    out.append("twin" if alike else None)
            keep = pa.array([o is not None for o in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (at["g"], at["a"], at["b"], pa.array(out, pa.string()))], names=["g", "a", "b", "verdict"])

    return pairs.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"]).mapInArrow(verify, "g string, a long, b long, verdict string")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(g, node, root): each node with the least node of its component, by hash-to-minimum rounds with shared checkpoints."""
    both = cut(links.select("g", "a", "b").unionByName(links.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    root = cut(nodes.select("g", "node", F.col("node").alias("root")).distinct())
    while True:
        heard = both.join(root.withColumnRenamed("node", "b"), ["g", "b"]).groupBy("g", F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        new = root.join(heard, ["g", "node"], "left").select("g", "node", F.least("root", F.coalesce("heard", "root")).alias("root"), (F.coalesce("heard", "root") < F.col("root")).alias("changed"))
        # jump to the root of the root
        jump = new.select("g", F.col("node").alias("root"), F.col("root").alias("further"))
        new = cut(new.join(jump, ["g", "root"], "left").select("g", "node", F.coalesce("further", "root").alias("root"), "changed"))
        root = new.select("g", "node", "root")
        if new.where("changed").isEmpty():
            return root
