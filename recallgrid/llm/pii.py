"""Personal information in free text: found, and replaced by typed placeholders.

Method: a linear-chain conditional random field over word-shape features (small
word classes, the name lexicon and the common words of a public vocabulary among
them), trained on the driver from a small labelled table (``TRAINING`` texts, a
documented bound), decoded by Viterbi in numpy batches on the executors. An
exact check of form follows each find (a phone number has 7 to 15 digits, an
e-mail an at sign and a domain, and so on).

Defined results: types are email, phone, id_number, address and person; the
surface is the text as written; null and blank texts give nothing; texts of any
length are decoded whole; of overlapping finds there are none, since each token
has one label. Repeated rows give repeated finds unless made distinct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import ARRAY_FIELDS, parse, unwrap
from ..session import checkpoint_dir
from ..sources.store import Files
from .crf import LABELS, TOKEN, TYPE_OF, Model, Scores, emissions, form_of, train, viterbi
from .pii_examples import labelled_table
from .tokenizer import VOCABULARY, read_ranks

#: Size of the labelled table.
TRAINING = 10_000
#: Public vocabularies that tell common words from others; a parameter.
VOCABULARIES = (VOCABULARY, VOCABULARY.replace("_50k", "_multi_50k"))
#: Name words of the lexicon that the driver reads at most.
MAX_LEXICON = 100_000
#: Payload fields that hold free text (fixed values of the data model).
TEXT_FIELDS = frozenset(("text", "title", "note", "message"))
_MODELS: dict[tuple, Model] = {}


def label_tokens(pieces: list[tuple[str, str]]) -> tuple[list[str], list[int]]:
    """Tokens and labels of a text given in labelled pieces."""
    text, spans = "", []
    for part, label in pieces:
        if label:
            spans.append((len(text), len(text) + len(part), form_of(label, part)))
        text += part
    tokens, labels, j = [], [], 0
    for m in TOKEN.finditer(text):
        while j < len(spans) and spans[j][1] <= m.start():
            j += 1
        inside = j < len(spans) and spans[j][0] < m.end() and m.start() < spans[j][1]
        first = inside and (not tokens or last_span != j)
        tokens.append(m[0])
        labels.append(LABELS.index(f"{'B' if first else 'I'}-{spans[j][2]}") if inside else 0)
        last_span = j if inside else -1
    return tokens, labels


def common_words(paths: tuple[str, ...] = VOCABULARIES) -> frozenset:
    """Words of the public vocabularies, as they are written at the start of a word: some ten thousand."""
    out = set()
    for path in paths:
        with open(path, "rb") as f:
            for piece in read_ranks(f.read()):
                w = piece.decode("utf-8", "ignore")
                if len(w) > 3 and w[0] == " " and w[1:].isalpha() and w[2:].islower():
                    out.add(w[1:])
    return frozenset(out)


def model_from(lexicon_rows: list[tuple[str, str]], size: int = TRAINING, vocabularies: tuple[str, ...] = VOCABULARIES) -> Model:
    """The tagger of a lexicon, trained once per driver process."""
    key = (size, vocabularies, tuple(sorted(lexicon_rows)))
    if key not in _MODELS:
        names: dict[str, str] = {}
        for token, kind in lexicon_rows:
            for w in (token.lower(), *token.lower().split("-")):
                names[w] = kind if names.get(w, kind) == kind else "both"
        words = common_words(vocabularies)
        texts = [label_tokens(p) for p in labelled_table(list(lexicon_rows), size, words=words)]
        _MODELS[key] = train([t for t in texts if t[0]], names, words)
    return _MODELS[key]


def stored_model(spark: SparkSession, lexicon_rows: list[tuple[str, str]], size: int = TRAINING, vocabularies: tuple[str, ...] = VOCABULARIES) -> Model:
    """The same, kept in the shared folder under a digest of all it is made from, so that it is fitted once per cluster."""
    import hashlib
    import inspect
    import pickle

    from . import crf, pii_examples

    key = (size, vocabularies, tuple(sorted(lexicon_rows)))
    if key not in _MODELS:
        made_from = repr((*key, inspect.getsource(crf), inspect.getsource(pii_examples)))
        files, name = Files(spark, checkpoint_dir(spark)), f"tagger-{hashlib.sha256(made_from.encode()).hexdigest()[:24]}"
        data = files.read(name)
        if data is None:
            files.write(name, pickle.dumps(model_from(lexicon_rows, size, vocabularies)))
        else:
            _MODELS[key] = pickle.loads(data)
    return _MODELS[key]


def lexicon_of(names: DataFrame) -> list[tuple[str, str]]:
    rows = names.filter("token is not null and kind is not null").select("token", "kind").distinct().limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the name lexicon has more than {MAX_LEXICON} rows")
    return sorted((r["token"], r["kind"]) for r in rows)


_TAIL = re.compile(r"[\s=,;:!?)\]>/'\"-]+$")
_HEAD = re.compile(r"^[\s=,;:!?\]>/'\".-]+")
_MAIL = re.compile(r"^[^\s@＠]+(?:@|＠|\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+)[^\s@＠]+(?:(?:\.|\s*\[dot\]\s*|\s+dot\s+)[^\s@＠]+)*$", re.I)


def check(kind: str, s: str) -> str | None:
    """The surface without punctuation around it, or None where its form is impossible."""
    s = _TAIL.sub("", _HEAD.sub("", s)) if kind != "phone" else s.strip(" ,;:.!?[]<>'\"-/")
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        s = s.rstrip(".")
        return s if _MAIL.match(s) and re.search(r"\.|dot", s, re.I) else None
    if kind == "phone":
        if s.count("(") != s.count(")"):
            s = s.strip("()")
        if s.startswith("(") and s.endswith(")"):
            s = s[1:-1]
        return s if 7 <= digits <= 15 and not any(c.isalpha() for c in s) else None
    if kind == "id_number":
        s = s.strip("(). ")
        return s if digits >= 6 else None
    if kind == "address":
        return s.lstrip("(") if digits and any(c.isalpha() for c in s) else None
    s = s.strip("(). ")
    return s if sum(c.isalpha() for c in s) >= 2 and not any(c.isdigit() for c in s) and "@" not in s else None


class Tagger:
    """Decodes texts in batches; one per worker task."""

    def __init__(self, model: Model, batch_tokens: int = 60_000):
        self.m, self.scores, self.batch_tokens = model, Scores(model), batch_tokens

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """For each text its finds as (start, end, type)."""
        split, ids = TOKEN.findall, self.scores.ids
        if self.scores.full():
            self.scores.clear()
        rows = [np.array(ids(split(t)), np.int32) for t in texts]
        out: list[list] = [[] for _ in texts]
        order = sorted((i for i in range(len(texts)) if len(rows[i])), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at + 1) * len(rows[order[stop]]) <= self.batch_tokens and len(rows[order[stop]]) <= 2 * len(rows[order[at]]) + 8:
                stop += 1
            part = order[at:stop]
            at = stop
            n = np.array([len(rows[i]) for i in part])
            padded = np.zeros((len(part), n[-1] + 6), np.int32)
            for j, i in enumerate(part):
                padded[j, 3 : 3 + n[j]] = rows[i]
            best = viterbi(emissions(self.scores.score, padded), self.m.trans, n)
            for j in np.flatnonzero(best.any(1)):
                out[part[j]] = self._spans(texts[part[j]], best[j])
        return out

    @staticmethod
    def _spans(text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
        out, start, end, kind = [], 0, 0, ""
        for m, lab in zip(TOKEN.finditer(text), [*labels.tolist()]):
            if LABELS[lab][0] == "I" and kind == TYPE_OF[lab]:
                end = m.end()
                continue
            if kind:
                out.append((start, end, kind))
            kind = TYPE_OF[lab]
            start, end = m.span()
        if kind:
            out.append((start, end, kind))
        good = []
        for a, b, k in out:
            s = check(k, text[a:b])
            if s:
                x = text.index(s, a)
                good.append((x, x + len(s), k))
        return good


def redact(text: str, finds: list[tuple[int, int, str]]) -> str:
    """The text with each find replaced by its type in brackets, the rest unchanged."""
    out, at = [], 0
    for a, b, k in finds:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def text_fields(payload: str | None, fields: frozenset = TEXT_FIELDS, array_fields=frozenset(ARRAY_FIELDS)) -> list[tuple[str, str]]:
    """(path, text) of the free texts of a payload."""
    if payload is None or ("\\u" not in payload and not any(f in payload for f in fields)):
        return []
    out, stack = [], [(unwrap(parse(payload)), "")]
    while stack:
        v, path = stack.pop()
        if type(v) is dict:
            for k, x in v.items():
                p = f"{path}/{k}" if path else k
                x = unwrap(x)
                t = type(x)
                if t is dict:
                    stack.append((x, p + "/0" if k in array_fields else p))
                elif t is list:
                    stack.append((x, p))
                elif t is str and k in fields and x:
                    out.append((p, x))
        elif type(v) is list:
            for i, x in enumerate(v):
                x = unwrap(x)
                if type(x) is dict or type(x) is list:
                    stack.append((x, f"{path}/{i}" if path else str(i)))
    return out


def _texts(places: str):
    """How a row's texts are reached: those of a JSON payload, or of a list."""
    if places == "payload":
        return text_fields
    return lambda items: [] if items is None else [(f"turns/{i}", t) for i, t in enumerate(items) if t]


def _run(model, places: str, what: str):
    reach = _texts(places)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model.value)
        for pdf in batches:
            rid, place, text = [], [], []
            for i, x in zip(pdf["row_id"], pdf["x"]):
                for p, t in reach(x):
                    rid.append(i), place.append(p), text.append(t)
            if not text:
                continue
            found = tagger.find(text)
            if what == "redact":
                yield pd.DataFrame({"row_id": rid, "place": place, "text": [redact(t, f) for t, f in zip(text, found)], "n_found": [len(f) for f in found]})
                continue
            rows = [(rid[j], place[j], k, text[j][a:b]) for j, f in enumerate(found) if f for a, b, k in f]
            if rows:
                yield pd.DataFrame(rows, columns=["row_id", "place", "pii_type", "surface"])

    return run


_OUT = {
    "find": "row_id string, place string, pii_type string, surface string",
    "redact": "row_id string, place string, text string, n_found int",
}


def personal_information(df: DataFrame, row_id: str, column: str, places: str, lexicon: DataFrame, what: str = "find") -> DataFrame:
    """Finds (row_id, place, pii_type, surface), or with ``what="redact"`` the texts (row_id, place, text, n_found).

    ``places`` is payload (a JSON column, fields of TEXT_FIELDS at any depth) or
    turns (a list column). The trained weights (a few MB, by the bounded
    training table) are broadcast; texts are read where they lie, nothing is
    shuffled.
    """
    spark: SparkSession = df.sparkSession
    model = spark.sparkContext.broadcast(stored_model(spark, lexicon_of(lexicon)))
    src = df.select(F.col(row_id).cast("string").alias("row_id"), F.col(column).alias("x")).filter("row_id is not null and x is not null")
    return src.mapInPandas(_run(model, places, what), _OUT[what])
