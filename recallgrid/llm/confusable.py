"""One form for texts that look the same but are made of different characters.

Method: the script sets of a token's letters (script extensions, with the
writing systems of Japanese, Korean and Chinese as UTS #39 has them), each
widened by the scripts of its look-alikes, are intersected. A token that mixes
scripts, or whose letters all look like letters of the Latin alphabet, is
spelled in the script that all of its letters allow (Latin first where several
do); remaining forms are normalised: width, composition of accents, invisible
characters, kinds of blank and of hyphen.

Which letters look alike is public data of UTS #39, read once from the ICU
library that Spark brings along (``look_alike_letters``); a short list of the
commonest is fixed here and goes before it.

Defined results: case, accents, words and digits stay as they are, raised
digits and letters too; letters are never taken for digits; a token of one
script stays as it is unless all of it can be read as Latin; dotless i and j and
the long s are letters of their own; a zero-width joiner between pictures stays,
since it changes them; null gives null; texts of any length are taken whole. The
form of a text depends on its looks only, and the form of a form is itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

# Letters of other scripts that look like a Latin letter, in the order of the Latin ones.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеһіјӏорԛѕсухԝԁ", "ABESIJKMHOPCTYXYGQWaehijlopqscyxwd"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEZHIKMNOPTYXovj"))
ARMENIAN = dict(zip("ՕՍօսհո", "OUouhn"))
#: Further equal looks: micro sign and Greek mu, kelvin and angstrom signs fold by composition.
SAME = {"µ": "μ"}
#: Letters that are no look-alikes though the public data has them: they lack or have a dot or bar (fixed values).
APART = frozenset("ıȷſ")
#: Kinds of hyphen, all given as the plain one.
HYPHENS = "\u2010\u2011\uFE63\uFF0D"
#: Invisible characters: soft hyphen, zero-width and direction marks, word joiners, byte order mark, variation selectors.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
#: Scripts that are written together, by the writing systems they belong to (fixed values of UTS #39).
TOGETHER = {"Han": {"Jpan", "Kore", "Hanb"}, "Hiragana": {"Jpan"}, "Katakana": {"Jpan"}, "Hangul": {"Kore"}, "Bopomofo": {"Hanb"}}

_BASE = {**CYRILLIC, **GREEK, **ARMENIAN}
_LETTERS = ("Lu", "Ll", "Lt", "Lo", "Nl")


def _plain_letter(c: str) -> bool:
    """A letter that isn't raised, lowered or made of others, and no ideograph."""
    if unicodedata.category(c) not in _LETTERS or c in APART or unicodedata.decomposition(c).startswith(("<super>", "<sub>", "<fraction>")):
        return False
    return not unicodedata.name(c, "").startswith(("CJK ", "HANGUL SYLLABLE", "TANGUT", "KHITAN", "NUSHU"))


def look_alike_letters(spark: SparkSession) -> dict[str, str]:
    """Letter -> its look of the public data, for all letters that share it with another; one call to the JVM."""
    letters = [c for c in map(chr, range(0x41, 0x20000)) if _plain_letter(c)]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    looks = checker.getSkeleton("\n".join(letters)).split("\n")
    if len(looks) != len(letters):
        raise RuntimeError("the look of a letter holds a line break")
    n: dict[str, int] = {}
    for x in looks:
        n[x] = n.get(x, 0) + 1
    return {c: x for c, x in zip(letters, looks) if n[x] > 1}


@lru_cache(1)
def _script_tests() -> tuple:
    """(script, test) of every script that letters' names begin with."""
    import regex

    names = {"Han", "Hiragana", "Katakana", "Hangul", "Bopomofo"}
    for cp in range(0x41, 0x20000):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L" and not 0x3400 <= cp < 0xA000 and not 0xAC00 <= cp < 0xD7B0:
            words = unicodedata.name(c, "").title().split(" ")
            names |= {words[0], "_".join(words[:2])}
    out = []
    for name in sorted(names - {""}):
        try:
            out.append((name, regex.compile(rf"\p{{scx={name}}}").match))
        except regex.error:
            continue
    return tuple(out)


@lru_cache(20_000)
def scripts(c: str) -> frozenset:
    """The scripts that a letter is used in, with the writing systems they are part of; empty for what any script uses."""
    if not c.isalpha() and unicodedata.category(c) != "Nl":
        return frozenset()
    if c.isascii():
        return frozenset(("Latin",))
    own = {name for name, test in _script_tests() if test(c)}
    if not own:
        own = {unicodedata.name(c, "?").split(" ")[0].title()}
    return frozenset(own.union(*(TOGETHER.get(s, ()) for s in own)))


class Looks:
    """For each letter the letters of other scripts that look like it, case by case."""

    def __init__(self, public: dict[str, str] | None = None):
        of: dict[tuple, dict[str, str]] = {}  # (look, case) -> script -> letter
        self.group: dict[str, dict[str, str]] = {}
        ascii_case = {}  # looks of Latin letters, for letters without case
        public = public or {}
        for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
            look = public.get(c, c)
            ascii_case.setdefault(look, "l" if c.islower() else "u")
            of.setdefault((look, "l" if c.islower() else "u"), {})["Latin"] = c
        own = {a: (public.get(b, b), "l" if b.islower() else "u") for a, b in _BASE.items()}
        for c, look in public.items():
            if c not in own:
                own[c] = (look, "l" if c.islower() else "u" if c.isupper() else ascii_case.get(look, "o"))
        for c, key in own.items():
            names = scripts(c)
            here = of.setdefault(key, {})
            for s in names - {"Latin"}:
                here.setdefault(s, c)
        for c, key in own.items():
            self.group[c] = of[key]
        for here in of.values():
            if "Latin" in here:
                self.group[here["Latin"]] = here

    def sets(self, token: str) -> list[tuple[frozenset, frozenset]]:
        """For each letter its own scripts, and those it could be spelled in without a change of looks."""
        out = []
        for c in token:
            own = scripts(c)
            group = self.group.get(c)
            if own or group:
                out.append((own, own | frozenset(group) if group else own))
        return out

    def spell(self, token: str) -> str:
        """The token in the one script that all its letters allow; in Latin as far as it goes if none does."""
        sets = self.sets(token)
        wide = frozenset.intersection(*(w for _, w in sets)) if sets else frozenset()
        to = "Latin"
        if wide and "Latin" not in wide:
            if frozenset.intersection(*(o for o, _ in sets)):
                return token
            to = min(wide)
        return "".join(self.group[c].get(to, c) if c in self.group else c for c in token)


_PLAIN: list[Looks] = []


def spell(token: str) -> str:
    """``Looks.spell`` by the fixed list alone."""
    if not _PLAIN:
        _PLAIN.append(Looks())
    return _PLAIN[0].spell(token)


class Former:
    """Brings texts to one form; remembers characters and tokens met."""

    def __init__(self, public: dict[str, str] | None = None, remembered: int = 100_000):
        import regex

        self.spell = Looks(public).spell

        self.tokens = regex.compile(r"[\p{L}\p{M}\p{Nl}]+")
        self.joiners = regex.compile("(?<![\\p{So}\\p{Sk}])\u200d|\u200d(?!\\p{So})")
        self.known: dict[str, str] = {}
        self.remembered = remembered
        table: dict[int, str | None] = dict.fromkeys(INVISIBLE)
        table |= {ord(c): "-" for c in HYPHENS} | {ord(a): b for a, b in SAME.items()}
        for cp in [*range(0xFF00, 0xFFF0), 0x3000]:  # wide and narrow forms
            c = chr(cp)
            if cp not in table and unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
                table[cp] = unicodedata.normalize("NFKC", c)
        for cp in (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
            table[cp] = " "
        self.table = table

    def _token(self, m) -> str:
        t = m[0]
        if t.isascii():
            return t
        got = self.known.get(t)
        if got is None:
            got = self.spell(t)
            if len(t) < 64:
                if len(self.known) >= self.remembered:
                    self.known.clear()
                self.known[t] = got
        return got

    def form(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        text = self.joiners.sub("", text.translate(self.table))
        text = unicodedata.normalize("NFD", text)
        return unicodedata.normalize("NFC", self.tokens.sub(self._token, text))


_FORMER: dict[int, Former] = {}


def former(public: dict[str, str]) -> Former:
    """One per worker process and table."""
    key = hash(frozenset(public.items()))
    if key not in _FORMER:
        _FORMER[key] = Former(public)
    return _FORMER[key]


def form_column(spark: SparkSession, text: Column) -> Column:
    """The one form of a text column. The table of look-alikes (some thousand letters) is broadcast."""
    public = spark.sparkContext.broadcast(look_alike_letters(spark))

    @F.arrow_udf("string")
    def formed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = former(public.value).form
        for batch in batches:
            yield pa.array([f(t) for t in batch.to_pylist()], pa.string())

    return formed(text)


def one_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """df with the one form of column ``text`` in column ``out``."""
    return df.withColumn(out, form_column(df.sparkSession, F.col(text)))


def digest_column(spark: SparkSession, text: Column) -> Column:
    """SHA-256 of the one form; null for null texts and for those without a letter or digit."""
    public = spark.sparkContext.broadcast(look_alike_letters(spark))

    @F.arrow_udf("binary")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        f = former(public.value).form
        for batch in batches:
            forms = [f(t) for t in batch.to_pylist()]
            yield pa.array([hashlib.sha256(t.encode()).digest() if t is not None and any(map(str.isalnum, t)) else None for t in forms], pa.binary())

    return digests(text)


def _digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, f): key, digest of the text, digest of its form, written once; the texts stay where they are."""
    d = df.select(F.col(key).alias("k"), F.unhex(F.sha2(text, 256)).alias("t"), digest_column(df.sparkSession, F.col(text)).alias("f"))
    # filtered after the cut: a filter on the digest would have it made twice
    return Scratch(df.sparkSession, "forms").cut(d).filter("f is not null and k is not null")


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, n_rows): rows whose text has a look-alike, with the smallest key that looks the same.

    Groups are reduced map-side before they are joined back, so a text that a
    third of all rows share costs one row per map task.
    """
    d = _digests(df, key, text)
    g = d.groupBy("f").agg(F.min("k").alias("class_id"), F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("a"), F.max("t").alias("b")).filter("a <> b")
    return d.join(g, "f").select(F.col("k").alias(key), "class_id", "n_rows")


#: Rows of one spelling, and spellings of one form, that a join group holds at most.
GROUP = 20_000


def look_alike_pairs(df: DataFrame, key: str, text: str, group: int = GROUP) -> DataFrame:
    """(key_a, key_b), smaller first: rows whose texts look the same but are not identical.

    Rows are counted by form and spelling (map-side), so what is joined on the
    form are spellings, not rows: copies of one text cost one row there. Each
    pair of spellings is then expanded to its rows. A form with more than
    ``group`` spellings, and a spelling with more than ``group`` rows, are cut
    into parts by hash, so no join group grows with a frequent text. The result
    lists all pairs, as is asked for here; ``look_alikes`` gives classes.
    """
    d = _digests(df, key, text)
    scratch = Scratch(df.sparkSession, "spellings")
    n = d.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"))
    forms = n.groupBy("f").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    cut = lambda c: F.ceil(F.col(c) / F.lit(group)).cast("int")
    sp = scratch.cut(n.join(forms, "f").select("f", "t", cut("n").alias("parts"), cut("m").alias("cuts")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = sp.select("f", F.col("t").alias("ta"), F.col("parts").alias("pa"), F.pmod(F.xxhash64("t"), F.col("cuts")).cast("int").alias("cut"))
    b = sp.select("f", F.col("t").alias("tb"), F.col("parts").alias("pb"), every("cuts").alias("cut"))
    both = a.join(b, ["f", "cut"]).filter("ta < tb").select("ta", "pa", "tb", every("pb").alias("sb"))
    both = both.select("ta", every("pa").alias("sa"), "tb", "sb")
    rows = d.join(sp.select("t", "parts"), "t").select("t", "k", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("s"))
    left = both.join(rows.select(F.col("t").alias("ta"), F.col("s").alias("sa"), F.col("k").alias("ka")), ["ta", "sa"])
    full = left.join(rows.select(F.col("t").alias("tb"), F.col("s").alias("sb"), F.col("k").alias("kb")), ["tb", "sb"]).filter("ka <> kb")
    return full.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))
