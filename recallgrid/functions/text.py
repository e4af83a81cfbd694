"""Text functions as native column expressions; no Python on the data path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without meaning for retrieval.
STOP_WORDS = (
    "a an and are as at be been being but by did do does for from had has have he her here him his how i if in into is it its me my of on or our "
    "she so than that the their them then there they this to up us was we were what when where which who why will with would you your"
).split()
# Fixed values (TXT-04 of the survey): verbs that stand alone, verbs that need a preposition, those prepositions; sorted.
PLAIN_VERBS = (
    "are avoids created dislikes drives enjoys founded has hates have is joined knows leads likes loves manages met needs owns plays prefers speaks teaches uses visited wants wrote"
).split()
PREPOSITION_VERBS = "based born lives moved studied studies traveled works".split()
PREPOSITIONS = "at in to from".split()

SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """Lower-case alphanumeric runs in order; null gives an empty list."""
    return F.filter(F.split(F.lower(F.coalesce(_c(c), F.lit(""))), SPLIT), lambda w: w != "")


def stem(w: Column) -> Column:
    """Light stemmer for ASCII words: -ing, -ies, -ed, plural -s, by the first rule that fits."""
    n = F.length(w)
    return (
        F.when(~w.rlike(r"^[\x00-\x7F]*$"), w)
        .when((n > 4) & w.endswith("ing"), F.substring(w, F.lit(1), n - 3))
        .when((n > 3) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & w.endswith("ed"), F.substring(w, F.lit(1), n - 2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss") & ~w.endswith("us"), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def tokens(c: Column | str) -> Column:
    """Words without stop words, stemmed."""
    return F.transform(F.filter(words(c), lambda w: ~w.isin(STOP_WORDS)), stem)


def subject(c: Column | str) -> Column:
    """Subject key: white space collapsed, trimmed, lower case; blank is null."""
    s = F.lower(F.trim(F.regexp_replace(_c(c), r"[\s\p{Z}]+", " ")))
    return F.when(s != "", s)


def triples(c: Column | str) -> Column:
    """array<struct<subject, relation, object>> of simple sentences, one per verb position."""
    sentences = F.split(_c(c), r"[.\n;!?]")

    def of(sentence: Column) -> Column:
        ws = F.filter(F.split(F.trim(F.regexp_replace(sentence, r"[\s\p{Z}]+", " ")), " "), lambda w: w != "")
        n = F.size(ws)

        def at(w: Column, i: Column) -> Column:
            low, nxt = F.lower(w), F.lower(F.get(ws, i + 1))
            plain = low.isin(PLAIN_VERBS)
            prep = (low.isin(PREPOSITION_VERBS) & nxt.isin(PREPOSITIONS)) | ((low == "married") & (nxt == "to"))
            rel = F.when(plain, low).when(prep, F.concat_ws("_", low, nxt))
            start = F.when(plain, i + 2).otherwise(i + 3)
            obj = F.array_join(F.slice(ws, start, F.greatest(n - start + 1, F.lit(0))), " ")
            good = (i > 0) & (i + 1 < n) & rel.isNotNull() & (obj != "")
            return F.when(good, F.struct(F.array_join(F.slice(ws, F.lit(1), F.greatest(i, F.lit(1))), " ").alias("subject"), rel.alias("relation"), obj.alias("object")))

        return F.when(n >= 3, F.filter(F.transform(ws, at), lambda t: t.isNotNull()))

    return F.flatten(F.filter(F.transform(sentences, of), lambda a: a.isNotNull()))


def triple_lines(c: Column | str) -> Column:
    """array<struct> of ``a | rel | b`` lines; relations lower case with underscores, other lines left out."""
    parts = F.transform(F.split(_c(c), "\n"), lambda l: F.transform(F.split(l, r"\|"), lambda p: F.trim(p)))
    good = F.filter(parts, lambda p: (F.size(p) == 3) & ~F.exists(p, lambda x: x == ""))
    return F.transform(good, lambda p: F.struct(p[0].alias("subject"), F.regexp_replace(F.lower(p[1]), " ", "_").alias("relation"), p[2].alias("object")))


def fact_list(c: Column | str) -> Column:
    """array<struct<subject, content>> from the outermost JSON array of a text; null where there is none."""
    found = F.regexp_extract(_c(c), r"(?s)(\[.*\])", 1)
    facts = F.from_json(F.when(found != "", found), "array<struct<subject:string,content:string>>")
    return F.filter(facts, lambda f: f["content"].isNotNull() & (F.trim(f["content"]) != ""))


def wikilinks(c: Column | str) -> Column:
    """Targets of ``[[Target#heading|alias]]`` in order, each once."""
    raw = F.regexp_extract_all(_c(c), F.lit(r"\[\[(.*?)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(F.regexp_extract(x, r"^([^#|]*)", 1))), lambda x: x != ""))


def frontmatter(c: Column | str) -> Column:
    """map of the leading ``---`` block's ``key: value`` lines; empty where there is none."""
    block = F.regexp_extract(_c(c), r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda l: l.rlike(r"^[^:]+:"))
    strip = lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")  # noqa: E731  no-break spaces too
    pairs = F.transform(lines, lambda l: F.struct(strip(F.regexp_extract(l, r"^([^:]+):", 1)).alias("k"), F.regexp_replace(strip(F.regexp_extract(l, r"^[^:]+:(.*)$", 1)), r'^"+|"+$', "").alias("v")))
    # of a repeated key the last value stands
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def body(c: Column | str) -> Column:
    """The text after a leading ``---`` block."""
    return F.regexp_replace(_c(c), r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")


def note_title(subj: Column | str, ident: Column | str) -> Column:
    """The subject, or ``memory-`` with the id's first part."""
    s = F.trim(_c(subj))
    return F.when(s.isNotNull() & (s != ""), s).otherwise(F.concat(F.lit("memory-"), F.substring_index(_c(ident), "-", 1)))


def file_name(title: Column | str) -> Column:
    """A title with characters that file systems refuse replaced by ``-``; ``untitled`` where nothing is left."""
    t = F.regexp_replace(_c(title), r'[/\\\\:*?"<>|#^\[\]\p{Cntrl}]', "-")
    t = F.trim(F.regexp_replace(F.trim(t), r"^\.+|\.+$", ""))
    return F.when(t == "", F.lit("untitled")).otherwise(t)


def cache_key(prompt: Column | str, *scope: Column) -> Column:
    """Key of a cached answer: scope and collapsed lower-case prompt."""
    return F.concat_ws("\u001f", *scope, F.lower(F.trim(F.regexp_replace(_c(prompt), r"[\s\p{Z}]+", " "))))


def from_template(kind: Column, fields: Column) -> Column:
    """struct<content, subject, mem_type> of a named template; null where a required field is missing."""
    g = lambda k: F.when(F.trim(fields[k]) != "", F.trim(fields[k]))

    def out(content: Column, subj: Column, mem_type: str) -> Column:
        return F.when(content.isNotNull() & subj.isNotNull(), F.struct(content.alias("content"), subj.alias("subject"), F.lit(mem_type).alias("mem_type")))

    named = F.when(g("detail").isNotNull(), F.concat(g("name"), F.lit(" \u2014 "), g("detail"))).otherwise(g("name"))
    return (
        F.when(kind == "preference", out(F.concat(g("subject"), F.lit(": "), g("value")), g("subject"), "semantic"))
        .when(kind == "person", out(named, g("name"), "semantic"))
        .when(kind == "decision", out(F.concat(F.lit("Decision on "), g("topic"), F.lit(": "), g("decision")), g("topic"), "semantic"))
        .when(kind == "task", out(g("task"), g("task"), "procedural"))
    )


def embedding_text(event_type: Column, payload: Column, tags: Column, cut: int = 2048) -> Column:
    """What is embedded of an event: type, telling payload values, tags. Cut by characters.

    Values come in key order of the payload; nested ones as JSON text under 500 characters.
    """
    m = F.from_json(payload, "map<string,string>")
    keep = F.filter(
        F.map_entries(m),
        lambda e: ~e["key"].startswith("_") & e["value"].isNotNull() & (F.length(e["value"]) > 2) & ~e["value"].rlike(r"^[0-9A-Fa-f-]+$") & ~e["value"].rlike(r"^(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false)$"),
    )
    nested = lambda e: e["value"].rlike(r"^\s*[\[{]")
    values = F.transform(F.filter(keep, lambda e: ~nested(e) | (F.length(e["value"]) < 500)), lambda e: F.when(nested(e), e["value"]).otherwise(F.concat(e["key"], F.lit(": "), e["value"])))
    head = F.array(F.regexp_replace(event_type, r"\.", " "))
    tail = F.when(F.size(tags) > 0, F.array(F.array_join(tags, " "))).otherwise(F.array().cast("array<string>"))
    mid = F.coalesce(values, F.when(payload.isNotNull(), F.array(payload)).otherwise(F.array().cast("array<string>")))
    return F.substring(F.array_join(F.concat(head, mid, tail), ". "), 1, cut)
