"""The text operators: exact tokens, forms, mixtures by their rules, held-out accuracy of the tagger."""

import json
import random
import re
import unicodedata
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recallgrid.llm import confusable, mixture, pii, pii_examples, tokenizer

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 8


@pytest.fixture(scope="module")
def enc():
    with open(tokenizer.VOCABULARY, "rb") as f:
        return tokenizer.Encoder(tokenizer.read_ranks(f.read()))


def test_ids_equal_the_public_library(enc):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = tokenizer.WORDS.replace(r"\P{White_Space}", r"\S").replace(r"[^\p{White_Space}\p{L}\p{N}]", r"[^\s\p{L}\p{N}]").replace(r"\p{White_Space}", r"\s")
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=enc.ranks, special_tokens={})
    r = random.Random(0)
    texts = [t for t in pq.read_table(f"{D}/documents.parquet")["text"].to_pylist() if t]
    texts += ["".join(r.choice("ab '\n\t\u3000é漢🙂1²<|>") for _ in range(r.randrange(1, 80))) for _ in range(300)]
    texts += ["a" * 5000, " " * 3000 + "x", "é" * 1000, "<|endoftext|>", "don't we'll", "\x1c\x1d x"]
    for t in texts:
        ids = enc.encode(t)
        assert b"".join(enc_bytes(enc, ids)).decode() == t
        if "\x1c" not in t:
            assert ids == ref.encode_ordinary(t)


def enc_bytes(enc, ids):
    if not hasattr(enc, "_back"):
        enc._back = {i: b for b, i in enc.ranks.items()}
    return [enc._back[i] for i in ids]


def test_round_trip_and_long_words(enc):
    r = random.Random(2)
    for n in (1, 7, 47, 48, 49, 200, 3000):
        w = "".join(r.choice("abcdeé漢 ") for _ in range(n))
        b = w.encode()
        assert tokenizer.merge_short(b, enc.ranks) == tokenizer.merge_long(b, enc.ranks)
        assert b"".join(enc_bytes(enc, enc.encode(w))) == b


def test_encode_column(spark, enc):
    df = spark.createDataFrame([(1, "two words", 0), (2, "", 0), (3, None, 0), (4, "two words", 0)], "doc_id int, text string, ids int")
    got = rows(tokenizer.encode(df, "text"))
    two = enc.encode("two words")
    assert got == [(1, "two words", two), (2, "", []), (3, None, []), (4, "two words", two)]
    assert rows(tokenizer.encode(df.limit(0), "text")) == []


# 10


def disguise(r, text):
    pools = {v: k for table in (confusable.CYRILLIC, confusable.GREEK) for k, v in table.items()}
    out = []
    for c in text:
        x = r.random()
        if x < 0.1 and c in pools:
            c = pools[c]
        elif x < 0.2 and "!" <= c <= "~" and c not in "-" and c.isalnum():
            c = chr(ord(c) + 0xFEE0)
        elif x < 0.3 and c == " ":
            c = r.choice("\u00a0\u2007\u202f\u3000")
        elif x < 0.4 and c == "-":
            c = r.choice("\u2010\u2011")
        elif x < 0.5:
            c = unicodedata.normalize("NFD", c)
        out.append(c + (r.choice("\u200b\u2060\ufeff\u00ad") if r.random() < 0.03 else ""))
    return "".join(out)


def test_looks_decide_the_form():
    r, f = random.Random(5), confusable.Former()
    texts = [t for t in pq.read_table(f"{D}/documents.parquet")["text"].to_pylist() if t]
    for t in texts:
        want = f.form(t)
        assert f.form(want) == want
        assert f.form(disguise(r, t)) == want


@pytest.mark.parametrize("a, b", [("Resume", "résume"), ("Word", "word"), ("x2", "x²"), ("agent 1", "agent l"), ("0", "O"), ("a b", "ab"), ("a–b", "a-b"), ("👩\u200d💻", "👩💻")])
def test_other_texts_stay_apart(a, b):
    f = confusable.Former()
    assert f.form(a) != f.form(b)


def test_script_choice():
    assert confusable.spell("Аgеnt") == "Agent"
    assert confusable.spell("Kлюч") == "Ключ"
    assert confusable.spell("орел") == confusable.spell("opел") == "орел"
    assert confusable.spell("а") == "a"
    assert confusable.Former().form("ｶﾞ") == "ガ"


def test_public_look_alikes(spark):
    f = confusable.Former(confusable.look_alike_letters(spark))
    for a, b in (("αgent", "agent"), ("ɑɡent", "agent"), ("Ꭺgent", "Agent"), ("ⲟption", "option"), ("ⅰtem", "item"), ("Іtem", "Item"), ("ѕсоре", "scope")):
        assert f.form(a) == f.form(b) == b
    for a, b in (("ı", "i"), ("ſo", "fo"), ("l", "1"), ("O", "0"), ("I", "l"), ("aᵃ", "aa"), ("rn", "m"), ("エ", "工")):
        assert f.form(a) != f.form(b)
    for same in ("Ключ", "エージェント", "記憶する", "Αθήνα", "한국어", "naïve"):
        assert f.form(same) == same
    assert {"Jpan"} <= confusable.scripts("記") & confusable.scripts("す")
    r = random.Random(5)
    for t in [t for t in pq.read_table(f"{D}/documents.parquet")["text"].to_pylist() if t]:
        assert f.form(f.form(t)) == f.form(t) == f.form(disguise(r, t))


def test_pairs_of_frequent_texts_are_cut(spark):
    words = ["a key", "a kеy", "а key", "а kеy", "a\u00a0key"]
    data = [(i, words[i % 5 if i % 3 else 0]) for i in range(90)]
    df = spark.createDataFrame(data, "doc_id int, text string")
    want = sorted((i, j) for i, x in data for j, y in data if i < j and x != y)
    assert [tuple(x) for x in confusable.look_alike_pairs(df, "doc_id", "text", group=3).orderBy("doc_id_a", "doc_id_b").collect()] == want


def test_pairs_and_classes(spark):
    data = [(1, "a key", "x"), (2, "a key", "x"), (3, "a key", "x"), (4, "a kеy", None), (5, None, "x"), (6, "", "x"), (7, "…", "x"), (8, "…\u200b", "x"), (9, "other", "x"), (None, "a key", "x")]
    df = spark.createDataFrame(data, "doc_id int, text string, f string")
    assert rows(confusable.look_alike_pairs(df, "doc_id", "text")) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert rows(confusable.look_alikes(df, "doc_id", "text")) == [(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 1, 4)]
    assert rows(confusable.look_alike_pairs(df.limit(0), "doc_id", "text")) == []


# 9


def test_sainte_lague():
    # a textbook case: 7 seats for 53, 24, 23
    got = mixture.sainte_lague({"a": 0.53, "b": 0.24, "c": 0.23}, 7, 1, {"a": 9, "b": 9, "c": 9})
    assert {k: v[0] for k, v in got.items()} == {"a": 3, "b": 2, "c": 2}
    split = mixture.sainte_lague({"a": 0.5, "b": 0.5}, 10, 4, {"a": 2, "b": 99})
    assert sum(split["a"]) == 2 and sum(split["b"]) == 8 and [a + b for a, b in zip(split["a"], split["b"])] == [3, 3, 2, 2]


def test_seats_equal_dealing_one_by_one():
    r = random.Random(8)
    for _ in range(60):
        names = [f"s{i}" for i in range(r.randrange(1, 9))]
        shares = {s: r.choice([r.random(), r.random() / 500, 0.25]) for s in names}
        room = {s: r.choice([r.randrange(0, 40), 10**9]) for s in names}
        seats, won = r.randrange(0, 300), dict.fromkeys(names, 0)
        for _ in range(seats):
            open_ = [s for s in names if won[s] < room[s]]
            if not open_:
                break
            won[min(open_, key=lambda s: (-shares[s] / (2 * won[s] + 1), s))] += 1
        got = mixture.sainte_lague(shares, seats, 4, room)
        assert {s: sum(q) for s, q in got.items()} == won


def test_thousands_of_sources_get_their_blocks():
    shares = {f"s{i}": 0.5 / 5000 for i in range(5000)} | {"big": 0.5}
    got = mixture.sainte_lague(shares, 640_000, 16, dict.fromkeys(shares, 10**9))
    assert sum(got["big"]) == 320_000 and {sum(q) for s, q in got.items() if s != "big"} == {64}


def test_small_sources_are_mixed_and_reported(spark):
    docs = [(i, "word " * 20, "big") for i in range(3000)] + [(9000 + i, "word " * 20, f"tiny{i % 3}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id int, text string, source string")
    t = spark.createDataFrame([("big", 0.9985, 1), ("tiny0", 0.0005, 1), ("tiny1", 0.0005, 1), ("tiny2", 0.0005, 1), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    rep = {x["source"]: x for x in mixture.mixture(df, t)[1].collect()}
    assert rep["gone"]["blocks"] == 0 and rep["gone"]["share"] == 0
    for s in ("tiny0", "tiny1", "tiny2"):
        assert rep[s]["blocks"] > 0 and rep[s]["mixed_tokens"] > 0 and abs(rep[s]["share"] - 0.0005) < 0.0004


def test_mixture_keeps_shares_and_limits(spark):
    r = random.Random(6)
    docs = [(i, " ".join(["word"] * r.randrange(1, 30)), r.choice(["big", " BIG ", "big", "mid", "Small", "other", None]), 0) for i in range(6000)]
    docs += [(10_000, None, "big", 0), (10_001, "", "mid", 0)]
    df = spark.createDataFrame(docs, "doc_id int, text string, source string, tokens int")
    t = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.3, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    copies, report = mixture.mixture(df, t)
    rep = {x["source"]: x for x in report.collect()}
    limits = {"big": 1, "mid": 2, "small": 3}
    for s, share in (("big", 0.4), ("mid", 0.3), ("small", 0.3)):
        assert abs(rep[s]["share"] - share) < 0.01
        assert rep[s]["most_copies"] <= limits[s]
    assert rep["absent"]["share"] == 0
    got = rows(copies)
    assert len(set((d, c) for c, d, *_ in [(x[2], x[0]) for x in got])) == len(got)
    per_shard = {}
    for d, s, c, shard, n in got:
        per_shard[shard] = per_shard.get(shard, 0) + n
    assert set(per_shard) == set(range(mixture.SHARDS)) and max(per_shard.values()) < 1.25 * min(per_shard.values())
    assert got == rows(mixture.mixture(df, t)[0]) != rows(mixture.mixture(df, t, seed=18)[0])
    half = sum(x[4] for x in rows(mixture.mixture(df, t, total_tokens=5000)[0]))
    assert abs(half - 5000) < 300
    assert rows(mixture.mixture(df.limit(0), t)[0]) == [] == rows(mixture.mixture(df, t.limit(0))[1])


# 6


@pytest.fixture(scope="module")
def lexicon():
    t = pq.read_table(f"{D}/name_lexicon.parquet").to_pylist()
    return sorted((x["token"], x["kind"]) for x in t)


def accuracy(tagger, table):
    """(precision, recall) by type, and over all."""
    texts = ["".join(p for p, _ in x) for x in table]
    good, found, true = Counter(), Counter(), Counter()
    for x, text, finds in zip(table, texts, tagger.find(texts)):
        want = Counter((k, p.rstrip(".")) for p, k in x if k)
        got = Counter((k, text[a:b].rstrip(".")) for a, b, k in finds)
        for c, of in ((true, want), (found, got), (good, want & got)):
            for (k, _), n in of.items():
                c[k] += n
                c["all"] += n
    return {k: (good[k] / max(1, found[k]), good[k] / true[k]) for k in true}


def test_accuracy_on_settings_never_trained_on(lexicon):
    """Settings, streets, towns, domains, names and neutral words of the part that is kept out of training."""
    m = pii.model_from(lexicon)
    got = accuracy(pii.Tagger(m), pii_examples.labelled_table(lexicon, 1500, seed=99, part="test", words=m.words))
    print(got)
    assert min(got["all"]) > 0.9 and all(min(v) > 0.84 for v in got.values())


#: Sentences written by hand, with other names, streets and settings than any list of the labelled table.
BY_HAND = """
Ping {person:Rajesh Kumar} when the build is green.
You can text {phone:650-253-0000} tonight.
{address:1600 Pennsylvania Avenue} opened to visitors last week.
Her flat is {address:14 Oakridge Avenue, Apt 3}, near the station.
I spoke to {person:Maria Gonzalez} on Tuesday and she was happy.
The invoice for {person:Tom Hanley} went to {email:tom.hanley@brightside.co.uk} yesterday.
If you get stuck, ring {person:Aisha} on {phone:07911 123456}.
My social security number is {id_number:219-09-9999}, please keep it safe.
The parcel was left at {address:221B Baker Street}, London.
Our plumber {person:George Whitfield} charges by the hour.
Herr {person:Krüger} wohnt in der {address:Friedrichstraße 43} in Berlin.
Bitte melden Sie sich bei {person:Sabine Lorenz} unter {phone:030 901820}.
Meine Steuer-ID lautet {id_number:65 929 970 489}.
Je m'appelle {person:Camille Durand} et j'habite {address:12 rue des Rosiers} à Paris.
Vous pouvez joindre {person:Hugo Petit} au {phone:06 12 34 56 78} après 18 h.
El paquete es para {person:Elena Navarro}, {address:Calle de Alcalá 45}, Madrid.
Su DNI es {id_number:12345678Z} y su correo es {email:elena.navarro@correo.es}.
Yesterday {person:D. Okonkwo} and {person:Mei-Ling Zhao} reviewed the figures.
Dear Ms {person:Albright}, your order 1182-3391 has shipped.
The passport number {id_number:X1234567} was not readable.
NINO: {id_number:AB 12 34 56 C} was entered twice.
We open at 9:30 and close at 17:45 on weekdays.
Build 4.12.7 failed after 320 seconds on node 10.2.0.17.
Silver Falcon is the code name of the next release.
The Golden Gate Bridge was painted again in 2019.
Order number 555-12-889 is on its way.
Version 2.0 of the Hill Climb module reads the log aloud.
Take the second street on the left and park in lane 4.
He forwarded it to {email:sales@northwind.example}; nobody answered.
Fax {phone:(415) 555-2671} is out of order, use {phone:+1 415 555 2672} instead.
Deliver to {address:88 King's Road, Flat 2}, SW3 4NZ, before noon.
The landlord of {address:7 Elm Court} is {person:Victor Hale}.
{person:Olivia Brandt}'s phone was stolen, so {person:Jonas} called the bank.
Was {person:Ahmed Farouk} at the meeting on 12 March 2021?
Paid 4,500 dollars for 30 licences on 2023-05-01.
Our office moved from {address:Hauptstraße 5} to {address:Am Stadtpark 12}.
Réunion avec Mme {person:Lefort} mardi à 14:00.
Llama a {person:Javier Ortega} al {phone:612 345 678} mañana.
The marsh behind the stone house froze in the frost.
Ask {person:Birgit} whether the field trip is on.
Issue 4521 was closed by {person:Wei Zhang} and reopened by {person:Priya Nair}.
{person:Smith, John} is listed twice in the register.
"""


def test_sentences_by_hand(lexicon):
    table = []
    for line in BY_HAND.strip().split("\n"):
        parts = re.split(r"\{(\w+):([^{}]*)\}", line)
        table.append([p for i in range(0, len(parts), 3) for p in ((parts[i], ""), *([(parts[i + 2], parts[i + 1])] if i + 2 < len(parts) else [])) if p[0]])
    got = accuracy(pii.Tagger(pii.model_from(lexicon)), table)
    print(got)
    assert got["all"][0] > 0.85 and got["all"][1] > 0.75


def test_expectations_equal_sums_over_all_labellings():
    import itertools

    import numpy as np

    from recallgrid.llm import crf

    r = np.random.default_rng(3)
    n = len(crf.LABELS)
    em, tr = r.normal(size=(2, 3, n)).astype(np.float32), (r.normal(size=(n, n)) + crf.allowed()).astype(np.float32)
    mask = np.array([[True, True, True], [True, True, False]])
    g, pairs = crf.expectations(em, tr, mask)
    want_pairs = np.zeros((n, n))
    for b in range(2):
        t = int(mask[b].sum())
        total, at, pp = 0.0, np.zeros((t, n)), np.zeros((n, n))
        for p in itertools.product(range(n), repeat=t):
            if crf.LABELS[p[0]][0] == "I":
                continue
            x = float(np.exp(np.float64(sum(em[b, i, y] for i, y in enumerate(p)) + sum(tr[y, z] for y, z in zip(p, p[1:])))))
            total += x
            for i, y in enumerate(p):
                at[i, y] += x
            for y, z in zip(p, p[1:]):
                pp[y, z] += x
        assert np.allclose(g[b, :t], at / total, atol=1e-5)
        want_pairs += pp / total
    assert np.allclose(pairs, want_pairs, atol=1e-5)


def test_finds_and_placeholders(spark, lexicon):
    names = spark.createDataFrame(lexicon, "token string, kind string").withColumn("row_id", F.lit(1))
    pay = [
        ("E1", json.dumps({"text": "write me at zinik.lake@example.org"})),
        ("E1", json.dumps({"text": "write me at zinik.lake@example.org"})),
        ("E2", json.dumps({"raw": json.dumps({"commits": {"message": "on file under SSN 666-12-3456;"}})})),
        ("E3", json.dumps({"steps": [None, {"note": "spoke with Zinik Jaskwick today"}]})),
        ("E4", '{"text": "broken'),
        ("E5", None),
        ("E6", json.dumps({"text": "", "title": None, "other": "call me on 415-555-0131"})),
        ("E7", json.dumps({"text": "node 10.0.0.3 restarted " * 3000 + "call me on 415-555-0131"})),
    ]
    df = spark.createDataFrame(pay, "id string, payload string").withColumn("place", F.lit(2))
    got = rows(pii.personal_information(df, "id", "payload", "payload", names).distinct())
    assert got == [
        ("E1", "text", "email", "zinik.lake@example.org"),
        ("E2", "raw/commits/0/message", "id_number", "666-12-3456"),
        ("E3", "steps/1/note", "person", "Zinik Jaskwick"),
        ("E7", "text", "phone", "415-555-0131"),
    ]
    out = {x["row_id"]: x["text"] for x in pii.personal_information(df, "id", "payload", "payload", names, "redact").collect()}
    assert out["E1"] == "write me at [EMAIL]" and out["E2"] == "on file under SSN [ID_NUMBER];" and out["E7"].endswith("call me on [PHONE]")
    turns = spark.createDataFrame([(1, ["hi", None, "", "Tel (212) 555-0162"]), (2, None), (3, [])], "sample_id int, turns array<string>")
    assert rows(pii.personal_information(turns, "sample_id", "turns", "turns", names)) == [("1", "turns/3", "phone", "(212) 555-0162")]
    assert rows(pii.personal_information(df.limit(0), "id", "payload", "payload", names)) == []


def test_viterbi_is_exact(lexicon):
    import itertools

    import numpy as np

    from recallgrid.llm import crf

    r = np.random.default_rng(0)
    em, tr = r.normal(size=(3, 4, len(crf.LABELS))).astype(np.float32), (r.normal(size=(len(crf.LABELS),) * 2) + crf.allowed()).astype(np.float32)
    n = np.array([4, 2, 3])
    best = crf.viterbi(em, tr, n)
    ban = [0 if x[0] != "I" else -1e4 for x in crf.LABELS]
    for b in range(3):
        score = lambda p: ban[p[0]] + sum(em[b, i, x] for i, x in enumerate(p)) + sum(tr[x, y] for x, y in zip(p, p[1:]))  # noqa: B023, E731
        top = max(itertools.product(range(len(crf.LABELS)), repeat=int(n[b])), key=score)
        assert tuple(best[b, : n[b]]) == top


def test_text_fields_paths():
    p = json.dumps({"title": "a", "steps": {"note": "b", "calls": [{"args": {"text": "c"}}]}, "message": "[1]", "note": "{x"})
    assert sorted(pii.text_fields(p)) == [("note", "{x"), ("steps/0/calls/0/args/text", "c"), ("steps/0/note", "b"), ("title", "a")]
    assert pii.text_fields('{"te\\u0078t": "d"}') == [("text", "d")]
