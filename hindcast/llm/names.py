"""Variant spellings of names typed by people, linked to the person or organisation that is meant.

Method: spellings and reference names are blocked by the phonetic codes of their sorted tokens (a pair of tokens, or one that
may stand alone, also with one code or letter lost).  Within blocks they are compared token by token: Jaro-Winkler and a
nickname table decide which tokens are one.  Accepted pairs are clustered by connected components.  The nickname table is what
the reference table lists, completed by nicknames that the spellings themselves give beside a full name.

Spellings are compared with the reference names first, those that fit none then with each other and with the full spellings
that fit one, so a cluster may hang together through spellings, and people whom the reference table lacks form clusters too.
No spelling joins two references: one that fits several equally well has no edge.  It is settled where it stands, by the names
that its record mentions, or, if the record mentions none, by the corpus when it means one of them ``PREVAILS`` times as often
as all others together.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.components import connected_components
from hindcast.runtime import Scratch, shuffle_partitions, split_join

#: Least similarity of two tokens that may be one name, and of two that differ by one typing slip.
SIMILAR, SLIP = 0.92, 0.80
PREVAILS = 3
#: Titles before or after a name (fixed values).
TITLES = (
    "admiral", "ambassador", "bishop", "captain", "chairman", "chancellor", "chief", "colonel", "commissioner", "congressman", "congresswoman", "count",
    "delegate", "deputy", "director", "doctor", "general", "governor", "judge", "justice", "king", "lieutenant", "lord", "major", "mayor", "minister",
    "premier", "president", "prince", "princess", "professor", "queen", "representative", "secretary", "senator", "sergeant", "speaker",
)
FORMS_OF_ADDRESS = {"mr", "mrs", "ms", "miss", "dr", "the", "sir", "dame", "madam", "prof", "rev", "hon"}
#: What may follow a name to say through whom it speaks (fixed values).
ASIDES = re.compile(r"(?:\s*[,(–-]\s*|\s+)(?:a\s+|the\s+)?(?:via (?:an? )?aide|(?:via )?(?:a )?spokes(?:person|man|woman)|statement|press (?:office|secretary|officer)|office|official|aide|adviser|representative)\s*\)?\s*$")
FILLERS = {"of", "for", "and", "the", "&", "in", "on"}
NICK = re.compile(r"(?:^|\s)[\"“'‘(]\s*([^\"”()]+?)\s*[\"”'’)](?=\s|$|,)")
ACRONYM = re.compile(r"^(?:[A-Z]\.?){2,7}$")
CODES = {c: str(d) for d, group in enumerate(("", "bfpv", "cgjkqsxz", "dt", "l", "mn", "r")) for c in group}


def plain(text: str) -> str:
    """Without accents, underscores, joined words and odd blanks; case is kept."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace("_", " ")
    return " ".join(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text).split())


def phonetic(token: str) -> str:
    """Consonant classes of a token, neighbours of one class once."""
    out = ""
    for c in token:
        code = CODES.get(c, "")
        if code and code != out[-1:]:
            out += code
    return out


def with_loss(code: str) -> set[str]:
    """A code and, of longer ones, the codes with one class lost, whose neighbours may then be one."""
    lost = (code[:i] + code[i + 1 + (0 < i < len(code) - 1 and code[i - 1] == code[i + 1]) :] for i in range(len(code)))
    return {code} | (set(lost) if len(code) > 4 else set())


def less_one(name: str) -> set[str]:
    """A name and, of names that may be ``similar`` to others, the name with one letter lost.

    Names that differ by one slip share one of these: of a letter changed or two swapped, either is lost on both sides.
    """
    return {name} | ({name[:i] + name[i + 1 :] for i in range(len(name))} if len(name) > 3 else set())


def all_but_one(words: list[str]) -> set[str]:
    """Of several words those beside each one, in order of the alphabet, and of one word what ``less_one`` gives."""
    words = sorted(words)
    return {" ".join(words[:i] + words[i + 1 :]) for i in range(len(words))} if len(words) != 1 else less_one(words[0])


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(first, second)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def one_slip(a: str, b: str) -> bool:
    """Whether a and b differ by at most one letter added, lost, changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return len(x) <= 1 and len(y) <= 1 or len(x) == 2 and x == y[::-1]


@functools.lru_cache(400_000)
def nearness(a: str, b: str) -> int:
    """0: the same token, 1: one typing slip apart, 2: alike, 9: not one name."""
    if a == b:
        return 0
    if min(len(a), len(b)) <= 3:
        return 9
    likeness, slip = jaro_winkler(a, b), one_slip(a, b)
    return 1 if slip and likeness >= SLIP else 2 if likeness >= SIMILAR else 9


def similar(a: str, b: str) -> bool:
    return nearness(a, b) < 9


def title_of(token: str) -> str:
    """The title that a token is, or is short for."""
    word = token.rstrip(".")
    if word in TITLES:
        return word
    if token.endswith(".") and len(word) >= 3:
        return next((t for t in TITLES if t.startswith(word)), "")
    return next((t for t in TITLES if len(word) > 5 and one_slip(word, t)), "")


class Spelling:
    """What a spelling may say: readings as (given names, surname), a nickname, a title, and its tokens and letters."""

    def __init__(self, text: str):
        text = plain(text)
        self.acronym = text.replace(".", "").lower() if ACRONYM.match(text.replace(" ", "")) else ""
        text = ASIDES.sub("", text.lower())
        self.nick = self.title = ""
        found = NICK.search(text)
        if found:
            inner = found[1].strip()
            if title_of(inner):
                self.title = title_of(inner)
            else:
                self.nick = inner
            text = (text[: found.start()] + " " + text[found.end() :]).strip()
        parts = [p.strip() for p in text.split(",") if p.strip()]
        while len(parts) > 1 and (title_of(parts[-1]) or parts[-1] in FORMS_OF_ADDRESS):
            self.title = title_of(parts.pop()) or self.title
        words = [re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?|&", p) for p in parts]
        self.words = [w for p in words for w in p if w != "the"]
        if words:
            while len(words[0]) > 1 and (title_of(words[0][0]) or words[0][0].rstrip(".") in FORMS_OF_ADDRESS):
                self.title = title_of(words[0].pop(0)) or self.title
        bare = [[w.rstrip(".") for w in p] for p in words]
        self.readings: list[tuple[tuple[str, ...], str]] = []
        if len(bare) >= 2 and bare[0] and bare[1]:
            self.readings.append((tuple(bare[1]), " ".join(bare[0][-1:])))
        elif bare and bare[0]:
            only = bare[0]
            self.readings.append((tuple(only[:-1]), only[-1]))
            if len(only) > 1:
                self.readings.append((tuple(only[1:]), only[0]))

    def keys(self) -> set[str]:
        tokens = [w.rstrip(".") for w in self.words if w not in FILLERS]
        return block_keys(tokens, {last for _, last in self.readings}, {(given[0], last) for given, last in self.readings if given}, {self.acronym} - {""})

    def full(self) -> tuple[str, str] | None:
        """Given names and surname, if both are written out."""
        given, last = self.readings[0] if self.readings else ((), "")
        return (" ".join(given), last) if given and len(given[0]) > 2 and len(last) > 2 and not self.acronym else None

    def full_keys(self) -> set[str]:
        """Keys under which a full spelling meets others: the codes of its given name and surname, one of them with a loss."""
        name = self.full()
        if not name:
            return set()
        first, last = phonetic(name[0].split()[0]), phonetic(name[1])
        return {"-".join(sorted((x, last))) for x in with_loss(first)} | {"-".join(sorted((first, x))) for x in with_loss(last)}


@functools.lru_cache(50_000)
def spelling(text: str) -> Spelling:
    return Spelling(text)


@functools.lru_cache(20_000)
def acronyms(name: str, known: str) -> set[str]:
    words = [w for w in plain(name).lower().replace("'", "").split() if w not in FILLERS]
    return {"".join(w[0] for w in words)} | {k.replace(".", "").lower() for k in known.split("|") if k}


def block_keys(tokens: list[str], alone: set[str], names: set[tuple[str, str]], short: set[str]) -> set[str]:
    """Block keys of a name: phonetic codes of each two of its sorted tokens; of tokens that may stand ``alone``, codes with one
    lost and letters with one lost; of ``names`` the given name's code beside the surname's initial; of all tokens but one the
    letters; what it is ``short`` for."""
    codes = sorted({phonetic(t) for t in tokens if len(t) > 2} - {""})
    out = {"2" + "-".join(pair) for pair in combinations(codes, 2)}
    out |= {"1" + code for t in alone if len(t) > 2 for code in with_loss(phonetic(t))} | {"s" + part for t in alone for part in less_one(t)}
    out |= {f"g{phonetic(given)} {last[0]}" for given, last in names if len(given) > 2 and last}
    return out | {"w" + rest for rest in all_but_one(tokens)} | {"a" + x for x in short}


def reference_keys(name: str, kind: str, known: str) -> set[str]:
    words = plain(name).lower().split()
    if kind == "person":
        return {k for k in block_keys(words, {words[-1]}, {(words[0], words[-1])}, set()) if k[0] != "2"}
    return {k for k in block_keys([w for w in words if w not in FILLERS], set(), set(), acronyms(name, known)) if k[0] in "2wa"}


def short_for(word: str, full: str) -> bool:
    """Whether ``word`` (with a point, an apostrophe or without vowels) abbreviates ``full``."""
    letters = word.rstrip(".").replace("'", "").replace("’", "")
    if len(letters) < 2 or letters[0] != full[0]:
        return False
    at = 0
    for c in full:
        at += at < len(letters) and letters[at] == c
    return at == len(letters) and (word.endswith(".") or letters[-1] == full[-1] and ("'" in word or "’" in word or len(letters) <= 4))


@functools.lru_cache(20_000)
def words_of(name: str) -> tuple[str, ...]:
    return tuple(plain(name).lower().split())


@functools.lru_cache(20_000)
def nicks_of(known: str) -> frozenset[str]:
    return frozenset(plain(known).lower().split("|")) - {""}


def fits_organisation(said: Spelling, name: str, known: str) -> int:
    if said.acronym and said.acronym in acronyms(name, known):
        return 3
    left = [w for w in said.words if w not in FILLERS]
    for full in words_of(name):
        if full in FILLERS:
            continue
        hit = next((w for w in left if w.rstrip(".") == full), None) or next((w for w in left if similar(w.rstrip("."), full) or short_for(w, full)), None)
        if hit is None:
            return 0
        left.remove(hit)
    return 0 if left else 5


def diminutive(nick: str, first: str) -> bool:
    """Whether a nickname is the beginning of a first name, at least three letters, with up to two other letters at its end."""
    return len(nick) < len(first) and any(len(stem) >= 3 and first.startswith(stem) for stem in (nick, nick[:-1], nick[:-2]))


def fits_person(said: Spelling, name: str, role: str, known: str) -> tuple[int, bool, str | None]:
    """How well a spelling fits a person (0: not), whether by the exact surname, and the nickname it adds to a full name.

    The rank of the given name counts first, then how near the tokens are.
    """
    words = words_of(name)
    first, middle, last = words[0], words[1:-1], words[-1]
    best, exact, nicks = 0, False, nicks_of(known)
    for given, surname in said.readings:
        near = nearness(surname, last)
        if near == 9:
            continue
        exact = exact or near == 0
        rank = loose = 0
        if not given:
            if said.nick:
                rank = 4 if said.nick in nicks else 3 if diminutive(said.nick, first) else 0
            else:
                rank = (2 if said.title == role else 0) if said.title else 1
        else:
            head, rest = given[0], given[1:]
            initials = [x for x in rest if len(x) == 1]
            fullers = [x for x in rest if len(x) > 1]
            middle_fits = all(any(x == m[0] for m in middle) for x in initials) and all(any(similar(x, m) for m in middle) for x in fullers)
            if not middle_fits:
                rank = 0
            elif len(head) == 1:
                rank = 3 if head == first[0] and (rest or said.title == role and role) else 2 if head == first[0] else 0
            elif head == first:
                rank = 6
            elif similar(head, first):
                rank, loose = 5, nearness(head, first) == 2
            elif head in nicks:
                rank = 4
            elif diminutive(head, first):
                rank = 3
        if rank:
            best = max(best, 8 * rank - 4 * (near > 0) - 2 * (near == 2) - loose)
    adds = said.nick if best >= 34 and said.nick else None
    return best, exact, adds


def fits_spelling(a: Spelling, b: Spelling) -> tuple[int, bool]:
    """How well spelling a fits the full spelling b, taken as a name, and whether given name and surname are a slip apart at most."""
    name = b.full()
    if not name:
        return 0, False
    first = name[0].split()[0]
    near = any(given and nearness(last, name[1]) + nearness(given[0], first) <= 1 for given, last in a.readings)
    return fits_person(a, f"{name[0]} {name[1]}", b.title, b.nick)[0], near


def judged_pairs(pairs: DataFrame) -> DataFrame:
    """``form, actor_id, fit, exact, nick, surname_only`` of candidate pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for form, actor_id, name, kind, role, known in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "person":
                    fit, exact, nick = fits_person(spelling(form), name, role, known)
                    if fit or exact:
                        out.append((form, actor_id, fit, exact, nick))
                elif fit := fits_organisation(spelling(form), name, known):
                    out.append((form, actor_id, 8 * fit, True, None))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=["form", "actor_id", "fit", "exact", "nick"])

    known = F.array_join(F.coalesce("known_as", F.array().cast("array<string>")), "|").alias("known")
    return pairs.select("form", "actor_id", "name", "kind", F.lower(F.coalesce("role", F.lit(""))).alias("role"), known).mapInArrow(run, "form string, actor_id string, fit int, exact boolean, nick string")


def keyed(df: DataFrame, columns: list[str], of) -> DataFrame:
    """``df`` with one row for each block key of it."""
    schema = df.select(*columns).schema.add("key", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for at, row in enumerate(batch.to_pylist()):
                for key in sorted(of(row)):
                    rows.append(at)
                    keys.append(key)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(keys, pa.string())], names=[*columns, "key"])

    return df.select(*columns).mapInArrow(run, schema)


def best_fits(judged: DataFrame) -> DataFrame:
    """Of each spelling the actors that fit best; none by a similar surname where its surname is somebody's exactly."""
    by_form = Window.partitionBy("form")
    marked = judged.withColumn("known_surname", F.max("exact").over(by_form)).filter("fit > 0 and (exact or not known_surname)")
    return marked.withColumn("top", F.max("fit").over(by_form)).filter("fit = top").withColumn("n_fit", F.count(F.lit(1)).over(by_form)).select("form", "actor_id", "fit", "n_fit")


def reference_fits(forms: DataFrame, people: DataFrame, scratch: Scratch) -> DataFrame:
    """``form, actor_id, fit, n_fit``: the reference names that each of ``forms`` (form) fits best."""
    spread = forms.repartition(shuffle_partitions(forms.sparkSession), "form")  # a small kept table is read by one task
    with_keys = scratch.keep(keyed(spread, ["form"], lambda r: spelling(r["form"]).keys()))
    names = lambda p: keyed(p, ["actor_id", "name", "kind", "known_as"], lambda r: reference_keys(r["name"], r["kind"], "|".join(k for k in r["known_as"] or () if k)))

    def match(f: DataFrame, p: DataFrame) -> DataFrame:
        pairs = split_join(f, names(p).select("key", "actor_id"), "key").select("form", "actor_id").distinct()
        return judged_pairs(pairs.join(p, "actor_id"))

    first = scratch.keep(match(with_keys, people))
    told = first.filter("nick is not null").groupBy("actor_id").agg(F.collect_set("nick").alias("told"))
    taught = people.join(told, "actor_id").withColumn("known_as", F.array_distinct(F.concat(F.coalesce("known_as", F.array().cast("array<string>")), "told"))).drop("told")
    second = match(with_keys.join(first.filter("fit > 0").select("form").distinct(), "form", "left_anti"), taught)
    both = first.unionByName(second).groupBy("form", "actor_id").agg(F.max("fit").alias("fit"), F.max("exact").alias("exact"))
    fits = scratch.keep(best_fits(both))
    scratch.drop(with_keys, first)
    return fits


def spelling_pairs(open_forms: DataFrame, fitted: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Accepted pairs of spellings that fit no reference: (``a, b``) with each other, (``a, actor_id``) with one that fits one.

    Full spellings meet by the codes of both tokens; with one that fits a reference a single slip is allowed, so that steps from
    spelling to spelling don't lead to another name.  ``fitted``: form, actor_id.
    """
    full = scratch.keep(
        keyed(open_forms.withColumn("actor_id", F.lit(None).cast("string")).unionByName(fitted), ["form", "actor_id"], lambda r: spelling(r["form"]).full_keys())
    )
    left = full.filter("actor_id is null").select("key", F.col("form").alias("a"))
    met = split_join(left, full.select("key", F.col("form").alias("b"), "actor_id"), "key").filter("a != b").select("a", "b", "actor_id").distinct()

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, actor in zip(*(c.to_pylist() for c in batch.columns)):
                fit, near = fits_spelling(spelling(a), spelling(b))
                keep.append(fit > 0 and (near or actor is None))
            yield batch.filter(pa.array(keep, pa.bool_()))

    accepted = scratch.keep(met.mapInArrow(alike, met.schema))

    return accepted.filter("actor_id is null").select("a", "b"), accepted.filter("actor_id is not null").select("a", "actor_id")


def short_links(open_forms: DataFrame, chains: DataFrame) -> DataFrame:
    """``a, b``: spellings with an initial only, and the head of the chain (form, chain) of full spellings of its surname.

    Only where all full spellings with this surname and initial are in one chain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, n[0], n[1][0]) for f in batch.column(0).to_pylist() for n in [short_name(spelling(f))] if n]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["form", "last", "given"])

    parsed = open_forms.mapInArrow(run, "form string, last string, given string").withColumn("initial", F.substring("given", 1, 1))
    whole = parsed.filter("length(given) > 2").join(chains, "form", "left").withColumn("head", F.coalesce("chain", "form"))
    named = whole.groupBy("last", "initial").agg(F.min("head").alias("b"), F.max("head").alias("other")).filter("b = other")
    return parsed.filter("length(given) = 1").join(named, ["last", "initial"]).select(F.col("form").alias("a"), "b")


def short_name(said: Spelling) -> tuple[str, tuple[str, ...]] | None:
    """Surname and given names of a spelling that has both, be it an initial."""
    given, last = said.readings[0] if said.readings else ((), "")
    return (last, given) if given and len(last) > 2 and not said.acronym else None


def name_clusters(forms: DataFrame, people: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Clusters of spellings (``form, head, actor_id``) and the references that unsettled ones fit (``form, actor_id``).

    ``head`` is the least member of a cluster; ``actor_id`` its reference, null for a cluster without one.  A spelling that is
    alone has no row.
    """
    fits = reference_fits(forms, people, scratch)
    sure = fits.filter("n_fit = 1").select("form", "actor_id")
    open_forms = forms.join(fits.select("form").distinct(), "form", "left_anti")
    among, across = spelling_pairs(open_forms, sure, scratch)
    chains = scratch.keep(connected_components(among, "a", "b", "form", "chain"))
    chained = across.withColumnRenamed("a", "form").join(chains, "form", "left").select(F.coalesce("chain", "form").alias("chain"), "actor_id").distinct()
    single = chained.groupBy("chain").agg(F.min("actor_id").alias("actor_id"), F.max("actor_id").alias("other")).filter("actor_id = other")
    tag = lambda kind, c: F.concat(F.lit(f"{kind} "), c)
    edges = (
        sure.select(tag(1, "form").alias("a"), tag(0, "actor_id").alias("b"))
        .unionByName(among.unionByName(short_links(open_forms, chains)).select(tag(1, "a").alias("a"), tag(1, "b").alias("b")))
        .unionByName(single.select(tag(1, "chain").alias("a"), tag(0, "actor_id").alias("b")))
    )
    clusters = connected_components(edges, "a", "b", "member", "head").filter("member like '1 %'")
    heads = clusters.select(F.expr("substr(member, 3)").alias("form"), F.expr("substr(head, 3)").alias("head"), F.expr("if(head like '0 %', substr(head, 3), null)").alias("actor_id"))
    return scratch.keep(heads), fits.filter("n_fit > 1").select("form", "actor_id")


def typed_quotes(events: DataFrame, people: DataFrame) -> DataFrame:
    """``record_id, quote_no, form, actors`` of each quote whose speaker isn't written exactly like a reference name."""
    return (
        events.select("record_id", "actors", F.posexplode("direct_quotes").alias("quote_no", "q"))
        .select("record_id", "quote_no", F.col("q.speaker").alias("form"), "actors")
        .filter("record_id is not null and length(trim(form)) > 0")
        .join(people.select(F.col("name").alias("form")).distinct(), "form", "left_anti")
    )


def references(actors: DataFrame) -> DataFrame:
    return actors.select("actor_id", "name", "kind", "role", "known_as").filter("actor_id is not null and name is not null")


def distinct_forms(quotes: DataFrame) -> DataFrame:
    return quotes.select("form").distinct().repartition(shuffle_partitions(quotes.sparkSession), "form")


def speaker_groups(events: DataFrame, actors: DataFrame) -> DataFrame:
    """``form, group_id, actor_id``: the cluster of each spelling that has another or a reference in it.

    ``group_id`` is the cluster's reference, else its least spelling.  The same cases as in ``linked_speakers``.
    """
    people, scratch = references(actors), Scratch(events.sparkSession)
    clusters, _ = name_clusters(scratch.keep(distinct_forms(typed_quotes(events, people))), people, scratch)
    return clusters.select("form", F.col("head").alias("group_id"), "actor_id")


def linked_speakers(events: DataFrame, actors: DataFrame) -> DataFrame:
    """``record_id, quote_no, actor_id``: quotes whose speaker is an actor but isn't written exactly like an actor's name.

    Null, empty and blank speakers, quotes without an actor, and spellings that stay ambiguous have no row.  A record that is
    delivered again counts once.  An empty table gives an empty result.  Extra columns are not read.
    """
    people, scratch = references(actors), Scratch(events.sparkSession)
    quotes = scratch.keep(typed_quotes(events, people))
    clusters, unsure = name_clusters(scratch.keep(distinct_forms(quotes)), people, scratch)
    settled = clusters.filter("actor_id is not null").select("form", "actor_id")
    found = scratch.keep(quotes.join(settled, "form").select("record_id", "quote_no", "actor_id").distinct())

    often = found.groupBy("actor_id").agg(F.count(F.lit(1)).alias("n"))
    at = Window.partitionBy("record_id", "quote_no")
    named = unsure.join(people.select("actor_id", "name"), "actor_id").join(often, "actor_id", "left").fillna(0, ["n"])
    open_quotes = (
        quotes.join(named, "form")
        .dropDuplicates(["record_id", "quote_no", "actor_id"])
        .withColumn("here", F.array_contains("actors", F.col("actor_id")) | F.array_contains("actors", F.col("name")))
        .withColumn("n_here", F.sum(F.col("here").cast("int")).over(at))
        .withColumn("all_n", F.sum("n").over(at))
        .filter((F.col("n_here") == 1) & F.col("here") | (F.coalesce("n_here", F.lit(0)) == 0) & (F.col("n") >= PREVAILS * F.greatest(F.lit(1), F.col("all_n") - F.col("n"))))
    )
    return found.unionByName(open_quotes.select("record_id", "quote_no", "actor_id")).distinct()
