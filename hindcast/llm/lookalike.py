"""One form for texts that look the same.

Method: look-alike classes are the connected sets of a relation over strings and code points (union-find over the relation's
ends, so look-alikes of look-alikes fall together).  The member that the corpus holds most often represents its class.
Texts are decomposed canonically, rewritten greedily (longest match first, left to right) with a multi-pattern automaton of
all other members, and composed again.

Kept apart: case, accents, digits, raised and lowered signs, punctuation, line breaks, tabs and the number of blanks.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.runtime import Scratch, pairs_within, split_join

#: Letters of other alphabets and symbols that are drawn like a Latin letter, of Greek, Cyrillic, Armenian, Cherokee, Coptic,
#: Canadian and Lisu letters those that Unicode's table of confusables has (fixed values, in order of the Latin letters).
DRAWN_LIKE = {
    "A": "ΑАᎪᗅꓮ", "B": "ΒВᏴᗷꓐ", "C": "СϹᏟᑕⲤꓚ", "D": "Ꭰᗞꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝᖴꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻᕼⲎꓧ", "I": "ΙІӀⲒꓲ", "J": "ЈᎫͿᒍꓙ",
    "K": "ΚКᏦⲔꓗ", "L": "Ꮮᒪꓡ", "M": "ΜМᎷϺᗰⲘꓟ", "N": "ΝⲚꓠ", "O": "ΟОՕⲞꓳ", "P": "ΡРᏢᑭⲢꓑ", "Q": "Ԛ", "R": "Ꭱᖇꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢⲦꓔ",
    "U": "Սꓴ", "V": "ѴᏙᐯꓦ", "W": "ԜᎳꓪ", "X": "ΧХⲬꓫ", "Y": "ΥҮⲨꓬ", "Z": "ΖᏃꓜ",
    "a": "аαɑ", "b": "Ьƅ", "c": "сϲᴄⲥ", "d": "ԁ", "e": "е", "f": "ք", "g": "ɡց", "h": "һհ", "i": "іιı", "j": "јϳ",
    "k": "κкᴋ", "l": "ӏ", "m": "ᴍ", "n": "ո", "o": "оοօᴏⲟ", "p": "рρⲣ", "q": "ԛգ", "r": "гᴦ", "s": "ѕꜱ", "u": "սυᴜ",
    "v": "ѵνᴠ", "w": "ԝᴡ", "x": "хχ", "y": "уүγ", "z": "ᴢ",
}
#: Hyphens of every kind (fixed values).
HYPHENS = "-‐‑‒−˗⁃﹣－"
#: Compatibility decompositions that change the drawing of a sign's width, font, joining or breaking, not its form.
SAME_DRAWING = {"<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}


def invisible(ch: str) -> bool:
    """Signs that are not drawn: format controls, variation selectors and the grapheme joiner."""
    code = ord(ch)
    return unicodedata.category(ch) == "Cf" and not 0x600 <= code <= 0x8FF or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x180B, 0x180C, 0x180D)


def relation(letters: dict[str, str]) -> Iterator[tuple[str, str]]:
    """Pairs of strings that look the same, from rules over all code points, ``letters`` (a string -> signs drawn like it) and
    the hyphens above."""
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        category = unicodedata.category(ch)
        if category in ("Cn", "Co", "Cs"):
            continue
        if invisible(ch):
            yield ch, ""
        elif category == "Zs":
            yield ch, " "
        else:
            tag, _, rest = unicodedata.decomposition(ch).partition(" ")
            if tag in SAME_DRAWING:
                plain = "".join(chr(int(x, 16)) for x in rest.split())
                if not (plain.startswith(" ") and len(plain) > 1):
                    yield unicodedata.normalize("NFD", ch), unicodedata.normalize("NFD", plain)
    for latin, others in letters.items():
        for ch in others:
            yield ch, latin
    for ch in HYPHENS:
        yield ch, "-"


def classes(pairs: Iterator[tuple[str, str]]) -> dict[str, str]:
    """Member -> root of its look-alike class, by union-find."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return {x: root(x) for x in parent}


@functools.lru_cache(4)
def members(letters: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """The classes, made once in a process.  The table depends on Unicode and ``letters`` only, not on the data."""
    return classes(relation(dict(letters)))


def representatives(counts: dict[str, int], letters: tuple[tuple[str, str], ...] = tuple(DRAWN_LIKE.items())) -> dict[str, str]:
    """Member that the corpus holds -> representative: the class's most frequent member, of equals the shortest, then the first by code point.

    A string of several signs counts as its rarest sign.  What isn't drawn at all stays the empty string.
    """
    often = lambda x: min((counts.get(ch, 0) for ch in x), default=0)
    groups: dict[str, list[str]] = {}
    for x, r in members(letters).items():
        groups.setdefault(r, []).append(x)
    out = {}
    for group in groups.values():
        best = "" if "" in group else min(group, key=lambda x: (-often(x), len(x), x))
        out |= {x: best for x in group if x != best and often(x)}
    return out


def member_counts(df: DataFrame, text_col: str = "text", letters: tuple[tuple[str, str], ...] = tuple(DRAWN_LIKE.items())) -> DataFrame:
    """``member`` and ``n``: how often each sign that is, or is part of, a member of a class is found in all decomposed texts.

    Every partition sends its own sums only; there are no more rows than the Unicode table has signs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {ch for x in members(letters) for ch in x}
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(unicodedata.normalize("NFD", text))
        kept = [(x, n) for x, n in total.items() if x in known]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["member", "n"])

    return df.select(text_col).mapInArrow(run, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))


class Rewriter:
    def __init__(self, rewrite: dict[str, str]):
        self.any = any(rewrite)
        self.automaton = ahocorasick.Automaton()
        for member, best in rewrite.items():
            if member:
                self.automaton.add_word(member, (len(member), best))
        self.automaton.make_automaton()
        starts = {x[0] for x in rewrite if x}
        held = (chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF)
        touched = [ch for ch in held if ch in starts or ord(ch) > 0x7F and not starts.isdisjoint(unicodedata.normalize("NFD", ch))]
        self.touched = re.compile("[" + re.escape("".join(touched)) + "\U00010000-\U0010ffff]").search

    def form(self, text: str) -> str:
        """The one form of ``text``."""
        if not self.any or not self.touched(text):
            return unicodedata.normalize("NFC", text)
        text = unicodedata.normalize("NFD", text)
        out, at = [], 0
        for start, back, best in sorted([(end - size + 1, -size, best) for end, (size, best) in self.automaton.iter(text)]):
            if start >= at:
                out.append(text[at:start])
                out.append(best)
                at = start - back
        out.append(text[at:])
        return unicodedata.normalize("NFC", "".join(out))


@functools.lru_cache(4)
def rewriter(counts: tuple[tuple[str, int], ...], letters: tuple[tuple[str, str], ...]) -> Rewriter:
    return Rewriter(representatives(dict(counts), letters))


def one_form(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False, letters: dict[str, str] | None = None) -> DataFrame:
    """``id_col`` and the ``form`` of its text; equal forms are texts that look the same.

    A null text has a null form, an empty text an empty one.  Repeated rows come out repeated.  ``hashed``: instead of the
    form its 128-bit digest ``form_key``, the digest ``text_key`` of the text as it is, and ``visible``, whether any sign of it
    is drawn.  Two passes over the texts: sign counts, whose size Unicode bounds (it goes through the driver), then a narrow
    rewrite.  Columns besides the two are not read.  ``letters``: which signs are drawn like a string, else ``DRAWN_LIKE``.
    """
    table = tuple((DRAWN_LIKE if letters is None else letters).items())
    counts = tuple(sorted((x, n) for x, n in member_counts(df, text_col, table).collect()))
    kind = df.select(id_col).schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        form = rewriter(counts, table).form
        digest = lambda x: None if x is None else hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms = [None if x is None else form(x) for x in texts]
            if hashed:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(map(digest, forms), pa.binary()), pa.array(map(digest, texts), pa.binary()), pa.array([bool(x and x.strip()) for x in forms], pa.bool_())],
                    names=[id_col, "form_key", "text_key", "visible"],
                )
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=[id_col, "form"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ("form_key binary, text_key binary, visible boolean" if hashed else "form string"))


def several_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, form_key, text_key`` of rows whose form has different strings, with ``n_texts``, the number of these."""
    keyed = Scratch(df.sparkSession).keep(one_form(df, id_col, text_col, hashed=True).filter(F.col("visible") & F.col(id_col).isNotNull()).select(id_col, "form_key", "text_key"))
    several = keyed.select("form_key", "text_key").distinct().groupBy("form_key").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1")
    return keyed.join(several, "form_key")


def look_alike_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, group_id, n_links``: one row for each id whose text looks like another string.

    ``group_id`` is the least id with this form, ``n_links`` the number of other strings that look the same; copies are one
    string.  Null ids and texts and texts without a visible sign have no row; an id with several texts has a row a form.
    """
    kept = several_texts(df, id_col, text_col)
    least = kept.groupBy("form_key").agg(F.min(id_col).alias("group_id"))
    return kept.join(least, "form_key").select(id_col, "group_id", (F.col("n_texts") - 1).alias("n_links")).distinct()


def look_alike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_a`` < ``doc_b``: rows whose texts look the same and are not the same string.

    Null texts and texts without a visible sign are in no pair, exact copies are no pair of each other.  The groups of
    ``look_alike_groups``, expanded: pairs are made between the different strings of a form and then between their documents,
    so copies of one text never meet, and no task has all pairs of a form or all documents of a text.
    """
    kept = several_texts(df, id_col, text_col)
    texts = pairs_within(kept.select("form_key", "text_key").distinct(), "form_key", "text_key", "text_key", "other_key")
    first = split_join(kept.select("text_key", F.col(id_col).alias("x")), texts.select("text_key", "other_key"), "text_key")
    met = split_join(kept.select(F.col("text_key").alias("other_key"), F.col(id_col).alias("y")), first.select("other_key", "x"), "other_key").filter(F.col("x") != F.col("y"))
    return met.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
