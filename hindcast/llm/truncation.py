"""Texts that have lost their end, and how often each source loses it.

Method: a structural completeness check.  A stack automaton runs over the text: unclosed quotes, brackets, fences, markup,
objects, escapes and broken multibyte sequences mean a lost end, and so does a mark of omission or a blank left by the cut.
What remains are texts with a line whose last sentence has no terminator, which whole texts lack too.  There the baseline
decides: it is counted how often a sentence that begins like this ends here, and how often it goes on, in texts of the same
source.  What a source shows is weighed with what all sources show as ``PRIOR`` passages, and that likewise with what the last
words alone show, so one formula holds for frequent and rare shapes, large and small corpora.

A sentence counts by its shape: common words as they are, other words and digits by their kind.  An unfinished last word is
one that no text has inside.  Lengths at which a source cuts are told from its own lengths just below.  All counts are sums
of partition counts; only the common words, fewer than (mean words of a text) / ``COMMON``, go through the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.runtime import Scratch

COMMON = 0.08
#: Passages for which the corpus counts beside a source's own, and the last words beside a whole beginning.
PRIOR = 20
#: Least part of the passages of a shape that must end there, and least part of its beginning's passages that it makes up.
ENDS, BRANCH, BRANCH_COMMON = 0.3, 0.02, 0.004
#: A source's limit: a length with so many cut texts, and with so many times the whole-looking open texts of the lengths below.
LIMIT_CUTS, LIMIT_EXCESS, BELOW = 10, 2.0, 10
FLUSH = 200_000

MARK = re.compile(r"(…|\.\.\.|\[(?:truncated|cut|…|\.\.\.)\]|<truncated>)\s*$", re.I)
BROKEN = re.compile("(?:�|[\ud800-\udfff]|\\\\u[0-9a-fA-F]{0,3}|\\\\|&#\\d{0,6})$")
#: UTF-8 read as single bytes, and such a sequence that lacks its last bytes.
MISREAD = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
HALF_READ = re.compile("(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2})$")
STRING_FIELD = re.compile(r'"\w+"\s*:\s*"((?:[^"\\]|\\.)*)"')
HEADLESS = re.compile(r'^((?:[^"\\{]|\\.)*)"\s*,\s*"\w+"\s*:')
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)((?:\s[^<>]*)?)>")
OPEN_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?$")
#: Elements that have no end, or may lack it (fixed values).
ENDLESS = set("area base br col embed hr img input link meta source track wbr li dt dd p td th tr option thead tbody tfoot".split())
SENTENCE = re.compile(r"(?<=[.!?。！？])[\"”’»)\]]*\s+")
TERMINATED = re.compile(r"[.!?。！？][\"”’»)\]]*$")
TOKEN = re.compile(r"[\s/]+")
WORD = re.compile(r"[^\W\d_]+")
AROUND = "\"'“”„«»’‘()[]{},;:.!?"
DIGIT = re.compile(r"\d")
ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
CLOSING = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
PROSE_SIGNS = re.compile(r"[()\[\]{}“”«»„]")
FENCES = re.compile(r"```\w*")
OBJECT_SIGNS = re.compile(r'[{}\[\]"]')


def unescape(text: str) -> str:
    return ESCAPE.sub(lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else m[1]), text)


def open_object(text: str) -> bool:
    """Whether an object in ``text`` isn't closed: a stack of brackets with a state for strings and their escapes."""
    stack, at, start = [], 0, text.find("{")
    if start < 0:
        return False
    inside = False
    at = start
    size = len(text)
    while at < size:
        if inside:
            quote = text.find('"', at)
            if quote < 0:
                return True
            back = quote - 1
            while back >= at and text[back] == "\\":
                back -= 1
            inside = (quote - 1 - back) % 2 == 1
            at = quote + 1
            continue
        found = OBJECT_SIGNS.search(text, at)
        if not found:
            break
        sign = found[0]
        at = found.end()
        if sign == '"':
            inside = bool(stack)
        elif sign in "{[":
            stack.append(sign)
        elif stack:
            stack.pop()
    return bool(stack)


def open_markup(text: str) -> bool:
    """Whether markup isn't closed: a tag cut inside, or an element whose end is missing."""
    if "<" not in text:
        return False
    if OPEN_TAG.search(text[text.rfind("<") :]):
        return True
    stack: list[str] = []
    for end, name, rest in TAG.findall(text):
        name = name.lower()
        if name in ENDLESS or rest.endswith("/"):
            continue
        if not end:
            stack.append(name)
        elif name in stack:
            del stack[len(stack) - 1 - stack[::-1].index(name) :]
    return bool(stack)


def open_prose(text: str) -> bool:
    """Whether the last sentence, without a terminator, leaves a quotation or the bracket that it began with unclosed.

    Brackets that open inside a sentence are often slips of whole texts; the baseline judges those.
    """
    line = text[text.rfind("\n") + 1 :].strip()
    if not line or line[-1] in CLOSING or TERMINATED.search(line[-9:]):
        return False
    last = SENTENCE.split(line)[-1]
    stack: list[tuple[str, int]] = []
    for found in PROSE_SIGNS.finditer(last):
        sign = found[0]
        pair = CLOSING.get(sign, "„" if sign == "“" and stack and stack[-1][0] == "„" else "")
        if not pair:
            stack.append((sign, found.start()))
        elif stack and (stack[-1][0] == pair or sign == "”" and stack[-1][0] == "„"):
            stack.pop()
    return any(sign in "“«„" or at == 0 for sign, at in stack)


def prose_of(text: str) -> tuple[bool, str]:
    """Whether structure alone shows a lost end, and the prose whose ends are to be judged.

    For an object that is its longest text, also where the object was closed after the cut, with the prose around the object.
    """
    if text.count("```") % 2:
        return True, ""
    if "{" in text and open_object(text):
        return True, ""
    if '"' in text:
        fields = [f[1] for f in STRING_FIELD.finditer(text)] if "{" in text else []
        head = None if fields else STRING_FIELD.search(text) or HEADLESS.match(text)
        if fields or head:
            inner = unescape(max(fields, key=len) if fields else head[1])
            around = text[: text.find("{")] + "\n" + text[text.rfind("}") + 1 :] if fields else ""
            return False, "\n".join(x for x in (FENCES.sub("\n", around).strip(), inner) if x)
    stripped = text.strip()
    return False, "" if stripped[:3] == "```" or stripped[:1] == "{" else text


def sentences(prose: str) -> Iterator[tuple[str, bool]]:
    """Sentences of each line, and whether each has a terminator."""
    for line in prose.split("\n"):
        line = line.strip()
        if line:
            parts = SENTENCE.split(line)
            for part in parts[:-1]:
                yield part, True
            if parts[-1]:
                yield parts[-1], bool(TERMINATED.search(parts[-1][-9:]))


def tokens(sentence: str) -> list[str]:
    return TOKEN.split(sentence.rstrip(".!?。！？\"”’»"))


class Kinds(dict):
    """Token -> itself if common, else its kind; filled as tokens are met."""

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.common = common

    def __missing__(self, token: str) -> str:
        low = token.lower()
        kind = DIGIT.sub("#", low)
        if kind == low:
            base = low.strip(AROUND)
            if base not in self.common:
                kind = low.replace(base, "_A" if token.strip(AROUND)[:1].isupper() else "_a") if base else low
        if len(self) > 500_000:
            self.clear()
        self[token] = kind
        return kind


def key_of(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(parts)) - (1 << 63)


def lost(text: str) -> tuple[bool, str]:
    """Structure's verdict on a text, and its prose where it has none."""
    cut, prose = prose_of(text)
    if cut or not prose:
        return cut, ""
    last = prose.rstrip("\n\r")
    cut = bool(MARK.search(last[-40:]) or BROKEN.search(last[-9:]) or last[-1:].isspace() or open_prose(last)) or open_markup(last) or bool(HALF_READ.search(last[-4:]) and MISREAD.search(last))
    return cut, "" if cut else prose


def open_ends(prose: str, phrase: int) -> list[str]:
    """The last sentence of each line that has no terminator, or one right behind a digit; none for a text of one phrase."""
    lines = [x.strip() for x in prose.split("\n") if x.strip()]
    if len(lines) == 1 and len(TOKEN.split(lines[0])) <= phrase:
        return []
    return [SENTENCE.split(x)[-1] for x in lines if not TERMINATED.search(x[-9:]) or x[-2:-1].isdigit()]


READ = "field string, row_id long, source string, cut boolean, ends array<string>, open boolean, chars int, bytes int, token string, held long, inside long"


def read_texts(texts: DataFrame, phrase: int) -> DataFrame:
    """One pass over the texts: structure's verdict and the open line ends of each, and word counts of each task.

    A text's row has ``field, row_id, source, cut, ends, open`` (whether its last line is) and its lengths; a word's row has
    ``token, held`` (texts with it) and ``inside`` (places where another word follows).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        inside: Counter[str] = Counter()
        schema = pa.schema([("field", pa.string()), ("row_id", pa.int64()), ("source", pa.string()), ("cut", pa.bool_()), ("ends", pa.list_(pa.string())), ("open", pa.bool_()),
                            ("chars", pa.int32()), ("bytes", pa.int32()), ("token", pa.string()), ("held", pa.int64()), ("inside", pa.int64())])

        def row_batch(columns: dict[str, list | pa.Array], size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        def counts() -> pa.RecordBatch:
            words = list(inside.keys() | held.keys())
            batch = row_batch({"token": words, "held": [held[w] for w in words], "inside": [inside[w] for w in words]}, len(words))
            held.clear()
            inside.clear()
            return batch

        for batch in batches:
            texts, cuts, ends, still = batch.column(3).to_pylist(), [], [], []
            for text in texts:
                words = WORD.findall(text.lower())
                held.update(set(words))
                inside.update(words[:-1])
                cut, prose = lost(text)
                found = open_ends(prose, phrase) if prose else []
                cuts.append(cut)
                ends.append(found or None)
                still.append(bool(found) and not TERMINATED.search(prose.rstrip()[-9:]))
            sizes = {"chars": [len(x) for x in texts], "bytes": [len(x.encode("utf-8", "replace")) for x in texts]}
            yield row_batch({"field": batch.column(0), "row_id": batch.column(1), "source": batch.column(2), "cut": cuts, "ends": ends, "open": still} | sizes, len(texts))
            if len(inside) > FLUSH:
                yield counts()
        yield counts()

    return texts.select("field", "row_id", "source", "text").mapInArrow(run, READ)


def source_key(source: str | None, key: int) -> int:
    return key_of([repr(source), str(key)])


def shape_counts(texts: DataFrame, common: frozenset[str]) -> DataFrame:
    """``key``, ``ends`` and ``on``: how often a sentence ends with this shape, or goes on after it.

    Keys are of whole beginnings, over all sources and of each source, and of last three tokens over all sources.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(common)
        shapes: Counter[tuple[str | None, str]] = Counter()

        def out() -> pa.RecordBatch:
            ends: Counter[int] = Counter()
            on: Counter[int] = Counter()
            for (source, shape), n in shapes.items():
                parts = shape.split(" ")
                on[key_of([])] += n
                for size in range(1, len(parts) + 1):
                    where = ends if size == len(parts) else on
                    key = key_of(parts[:size])
                    where[key] += n
                    where[source_key(source, key)] += n
                    where[key_of(["…", *parts[max(0, size - 3) : size]])] += n
            keys = list(ends.keys() | on.keys())
            shapes.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([ends[k] for k in keys], pa.int64()), pa.array([on[k] for k in keys], pa.int64())], names=["key", "ends", "on"])

        for batch in batches:
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cut, prose = lost(text)
                if not cut:
                    shapes.update((source, " ".join(map(kinds.__getitem__, tokens(s)))) for s, _ in sentences(prose))
            if len(shapes) > FLUSH:
                yield out()
        yield out()

    return texts.select("source", "text").mapInArrow(run, "key long, ends long, on long").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("on").alias("on"))


def asked_shapes(ends: DataFrame, common: frozenset[str]) -> DataFrame:
    """``source, end`` with the keys of its shape: of the beginning, in its source, without its last token, of the last three;
    ``word``: its last word if that isn't common, and ``least``: the part of its beginning's passages that it must make up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(common)
        for batch in batches:
            keys, words, least = [], [], []
            for source, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = tokens(end)
                shape = list(map(kinds.__getitem__, parts))
                open_kind = "_" in shape[-1]
                key = key_of(shape)
                keys.append((key, source_key(source, key), key_of(shape[:-1]), key_of(["…", *shape[-3:]])))
                words.append((WORD.findall(parts[-1].lower()) or [None])[-1] if open_kind else None)
                least.append(0.0 if shape[-1][-1:] == "%" else BRANCH if open_kind or shape[-1][-1:] == "#" else BRANCH_COMMON)
            columns = list(zip(*keys)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns), pa.array(words, pa.string()), pa.array(least, pa.float64())],
                                             names=["source", "end", "key", "own", "parent", "tail", "word", "least"])

    return ends.mapInArrow(run, "source string, end string, key long, own long, parent long, tail long, word string, least double")


def truncated(texts: DataFrame, phrase: int = 3) -> DataFrame:
    """``field, row_id, source`` of every text, with ``cut``: whether it has lost its end.

    ``texts`` has ``field`` (string), ``row_id`` (long), ``source`` (string) and ``text``.  Null, empty and blank texts are
    never cut; texts of up to ``phrase`` words are too short for the baseline, only structure judges them.  Rows that are there
    twice come out once.  A null source is a source of its own.  Extra columns are not read.
    """
    scratch = Scratch(texts.sparkSession)
    source = texts.select("field", F.col("row_id").cast("long").alias("row_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    filled = source.filter(F.length(F.trim("text")) > 0)
    read = scratch.keep(read_texts(filled, phrase))
    asked = read.filter("token is null").drop("token", "held", "inside")
    words = scratch.keep(read.filter("token is not null").groupBy("token").agg(F.sum("held").alias("held"), F.sum("inside").alias("inside")))
    total = asked.count()
    common = frozenset(r.token for r in words.filter(F.col("held") > COMMON * total).collect())
    shapes = scratch.keep(shape_counts(filled, common))

    ends = scratch.keep(asked_shapes(asked.select("source", F.explode("ends").alias("end")).distinct(), common))
    ask = ["key", "own", "parent", "tail", "word", "least"]
    part = lambda name: shapes.select(F.col("key").alias(name), F.col("ends").alias(f"{name}_ends"), F.col("on").alias(f"{name}_on"))
    known = words.filter("inside > 0").select(F.col("token").alias("word"), F.lit(True).alias("known"))
    found = ends.select(*ask).distinct()
    for name in ask[:4]:
        found = found.join(part(name), name, "left")
    found = found.join(known, "word", "left").na.fill(0, [f"{name}_{x}" for name in ask[:4] for x in ("ends", "on")])
    share: F.Column = F.try_divide(F.col("tail_ends"), F.col("tail_ends") + F.col("tail_on"))
    for name in ("key", "own"):
        share = (F.col(f"{name}_ends") + PRIOR * F.coalesce(share, F.lit(0.0))) / (F.col(f"{name}_ends") + F.col(f"{name}_on") + PRIOR)
    whole = (F.col("word").isNull() | F.col("known")) & (F.col("key_ends") >= F.col("least") * F.col("parent_on")) & (share >= ENDS)
    verdicts = found.select("own", F.col("word").alias("v_word"), (~F.coalesce(whole, F.lit(False))).alias("open_end"))
    judged = ends.join(verdicts, (ends["own"] == verdicts["own"]) & ends["word"].eqNullSafe(verdicts["v_word"])).select("source", "end", "open_end")
    bad = judged.filter("open_end").select(F.col("source").alias("b_source"), F.col("end").alias("b_end")).distinct()
    each = asked.withColumn("end", F.explode_outer("ends")).drop("ends")
    joined = each.join(bad, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("end") == F.col("b_end")), "left")
    marked = scratch.keep(
        joined.groupBy("field", "row_id", "source").agg(
            F.max(F.col("cut") | F.col("b_end").isNotNull()).alias("cut"), F.max("open").alias("open"), F.max("chars").alias("chars"), F.max("bytes").alias("bytes")
        )
    )
    scratch.drop(read, words, shapes, ends)
    return at_limits(marked)


def at_limits(marked: DataFrame) -> DataFrame:
    """Adds open texts whose length in characters or bytes is one at which their source's texts are cut.

    A cut at a limit may fall behind a sentence that looks whole.  A length is such a limit if many texts of the source were
    found cut there, and whole-looking open ones are more often there than at the lengths just below: the excess are cuts.
    """
    for size in ("chars", "bytes"):
        plain = F.col("open") & ~F.col("cut")
        many = marked.groupBy("field", "source", F.col(size).alias("l_size")).agg(F.count_if("cut").alias("n_cut"), F.count_if(plain).alias("n_open"))
        below = Window.partitionBy("field", "source").orderBy("l_size").rangeBetween(-BELOW, -1)
        usual = F.coalesce(F.sum("n_open").over(below), F.lit(0)) / BELOW
        limits = many.withColumn("usual", usual).filter((F.col("n_cut") >= LIMIT_CUTS) & (F.col("n_open") > LIMIT_EXCESS * F.col("usual")))
        chosen = limits.select(F.col("field").alias("l_field"), F.col("source").alias("l_source"), "l_size", F.lit(True).alias(f"{size}_limit"))
        on = (F.col("field") == F.col("l_field")) & F.col("source").eqNullSafe(F.col("l_source")) & (F.col(size) == F.col("l_size"))
        marked = marked.join(chosen, on, "left").drop("l_field", "l_source", "l_size")
    limited = F.coalesce("chars_limit", "bytes_limit", F.lit(False))
    return marked.select("field", "row_id", "source", (F.col("cut") | F.col("open") & limited).alias("cut"))


def truncation_share(marked: DataFrame) -> DataFrame:
    """``field, source, n_texts, n_cut, share``: how often each source loses the end of a text."""
    return marked.groupBy("field", "source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut")).withColumn("share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
