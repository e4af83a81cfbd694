"""A linear-chain conditional random field in numpy.

A token's features depend on its own characters only; a position's scores are
the sums of the features of the tokens at offsets -3..3. So the scores of each
distinct token are computed once, and a text is scored by table look-ups.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
TYPES = ("email", "phone", "id_number", "address", "person")
#: Labels tell the forms of a type apart, so that transitions keep a find in one form: addresses that begin with the
#: number and those that end with it; names with capitals, all in capitals, and in lower case.
FORMS = ("email", "phone", "id_number", "address1", "address2", "person1", "person2", "person3")
LABELS = ("O", *(f"{p}-{t}" for t in FORMS for p in "BI"))
#: Type of each label, "" for none.
TYPE_OF = tuple(x[2:].rstrip("123") for x in LABELS)


def form_of(kind: str, text: str) -> str:
    """The form of a find's text, as in FORMS."""
    if kind == "address":
        return kind + ("1" if text[:1].isdigit() else "2")
    if kind == "person":
        return kind + ("2" if text.isupper() and len(text) > 3 else "3" if text.islower() else "1")
    return kind


#: Words that are written with a dot, which is part of them (fixed values).
DOTTED = "St|Ave|Av|Rd|Ln|Blvd|Bd|Dr|Ct|Pl|Sq|Ter|Pkwy|Cres|Hwy|Apt|Ste|Mr|Mrs|Ms|Prof|Sra|Sr|Nr|Tel|ext|Avda|IdNr|str"
#: Dotted words and initials; runs of letters and digits joined by . _ + - (or O' before a name); line breaks; single other characters.
TOKEN = re.compile(
    rf"(?<![^\W_])(?:[^\W\d_]*(?<![^\W\d_])(?:{DOTTED})|[^\W\d_]+str)\.(?!\w)|(?<![^\W_])(?-i:[A-Z])\.(?![\w.])"
    r"|(?:[OoDd]['’](?=[^\W\d_]{2}))?[^\W_]+(?:[._+\-\u2010\u2011]+[^\W_]+)*|\n|[^\w\s]|_",
    re.I,
)
DIGIT = re.compile(r"\d")


def type_key(token: str) -> str:
    """Tokens of one key have the same features: long numbers differ in their digits only."""
    return token if len(token) <= 3 or not any(c.isdigit() for c in token) else DIGIT.sub("9", token[:-3]) + DIGIT.sub("9", token[-3:]) + "\t" + token[:3]


def shape(token: str) -> str:
    return "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in token)


def short_shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", shape(token))


# Small word classes of the four languages, each a feature of its words.
_CLASSES = {
    "street": "street st. st avenue ave ave. av. road rd rd. lane ln ln. court ct ct. drive dr dr. terrace close crescent parkway pkwy pkwy. way boulevard blvd blvd. bd. place pl. square sq. row hill walk trail circle highway hwy. alley mews gardens",
    "rue": "rue avenue allée impasse boulevard place chemin quai route cours square passage calle c avda. avda avenida paseo plaza camino ronda travesía carretera",
    "am": "am an im zum zur auf beim hinter unter",
    "unit": "suite flat apt apt. unit apartment floor ste. room",
    "title": "dr. prof. mr. mrs. ms. dr mr mrs ms mme mlle herr herrn frau monsieur madame señor señora sr. sra. don doña captain judge sir",
    "tel": "tel tel. telephone phone mobile cell fax telefon handy rufnummer téléphone tél portable teléfono móvil call dial ring text sms whatsapp hotline voicemail appelez llame joignable erreichbar",
    "idl": "ssn social security nir sécurité sociale sécu steuer-id idnr. idnr tin tax steuernummer steuer-identifikationsnummer steuer-idnr nino ni insurance dni nie nif documento identidad carné passport passeport pasaporte reisepass reisepassnummer pass-nr ausweisnummer personalausweis id",
    "thing": "order invoice part ticket build version seq serial article batch label reference model booking voucher lot tracking sku code hash commit row page line port shard run job step error total score bestellnummer artikel référence pedido factura bestellung rechnung number count",
    "month": "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday montag freitag lundi vendredi lunes viernes mai juni mayo",
    "small": "the a an and or of to in on at by for from with is was are be it this that as if but not no der die das und oder von zu mit ist war ein eine im am le la les un une et ou de du des à est el los las y o con es en por para une",
    "he": "who he she his her him my our your their we i you er sie sein ihr wir ich elle il son sa nous je ella él su yo",
}
_CLASS_OF: dict[str, list[str]] = {}
for _c, _ws in _CLASSES.items():
    for _w in _ws.split():
        _CLASS_OF.setdefault(_w, []).append("c=" + _c)
_GERMAN_STREET = re.compile(r".{3,}(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring|steig)$")


def features(token: str, lexicon: dict[str, str], words: frozenset = frozenset(), masked: bool = False) -> list[str]:
    """Word-shape features of one token; ``masked`` gives those of a word that was never seen.

    ``words`` are common words and proper nouns of a public vocabulary: lower-case
    entries are ordinary words, those that occur with a capital only are not.
    """
    token = token.replace("\u2010", "-").replace("\u2011", "-")
    low, sh = token.lower(), shape(token)
    out = ["bias", "s=" + short_shape(token)[:12], f"n={min(len(token), 12)}"]
    out += _CLASS_OF.get(low, [])
    if any(c.isdigit() for c in token):
        out += ["digit", "S=" + sh[:16]]
        if not masked:
            out += ["3=" + low[:3], "2=" + low[:2]]
            if len(token) <= 3:
                out.append("w=" + low)
    elif not token[0].isalnum():
        out.append("w=" + low)
    else:
        if not masked:
            out += ["w=" + low, "p3=" + low[:3], "e3=" + low[-3:], "e2=" + low[-2:], "e4=" + low[-4:]]
        if len(token) > 3 and token.isupper():
            out.append("upper")
        kind = "word" if low in words else "proper" if low.title() in words else "none"
        out += ["v=" + kind, "v=" + kind + short_shape(token)[:4]]
        if _GERMAN_STREET.match(low):
            out.append("c=straße")
    if ("." in token[:-1] or "_" in token or "+" in token) and token[0].isalnum():
        out.append("joined")
        if not token[-1].isdigit():
            out.append("host" if token[0].isalnum() and 2 <= len(low.rsplit(".", 1)[-1]) <= 7 and "." in token else "noted")
    kinds = {lexicon[p] for p in (low, *re.split(r"[-._+]", low)) if p in lexicon}
    out += ["lex=" + k for k in sorted(kinds)]
    if kinds:
        out.append("lex")
    if token.rstrip(".").isupper() and len(token.rstrip(".")) == 1:
        out.append("initial")
    return out


#: Shares of the training words that are met as they are, as unseen, and as unseen and missing from the lexicon.
MASKED = (0.55, 0.3, 0.15)


class Model:
    """Weights by offset, feature and label; transitions; and the scores of the tokens met so far."""

    def __init__(self, lexicon: dict[str, str], index: dict[str, int], weights: np.ndarray, trans: np.ndarray, words: frozenset = frozenset()):
        self.lexicon, self.index, self.weights, self.trans, self.words = lexicon, index, weights, trans, words

    def table(self) -> "Scores":
        return Scores(self)


class Scores:
    """Scores of distinct tokens: row 0 stands for the places before and after a text."""

    def __init__(self, model: Model, remembered: int = 300_000):
        self.m, self.remembered = model, remembered
        self._start()

    def _start(self) -> None:
        n = len(OFFSETS)
        self.rows: dict[str, int] = {}
        self.score = np.zeros((1024, n, len(LABELS)), np.float32)
        edge = self.m.index.get("edge")
        if edge is not None:
            self.score[0] = self.m.weights[:, edge]

    def ids(self, tokens: list[str]) -> list[int]:
        get = self.rows.get
        out = [get(t, -1) for t in tokens]
        if -1 in out:
            out = [self._row(t) if i < 0 else i for t, i in zip(tokens, out)]
        return out

    def _row(self, token: str) -> int:
        got = self.rows.get(token)
        if got is not None:
            return got
        key = type_key(token)
        row = self.rows.get(key)
        if row is None:
            row = self.count = getattr(self, "count", 0) + 1
            if row >= len(self.score):
                self.score = np.concatenate([self.score, np.zeros_like(self.score)])
            at = [self.m.index[f] for f in features(token, self.m.lexicon, self.m.words) if f in self.m.index]
            self.score[row] = self.m.weights[:, at].sum(1)
            self.rows[key] = row
        self.rows[token] = row
        return row

    def full(self) -> bool:
        return len(self.rows) > self.remembered

    def clear(self) -> None:
        self._start()
        self.count = 0


def emissions(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(B, T, L) of padded token rows (B, T + 6), with three places of padding at either end."""
    t = ids.shape[1] - 6
    return sum(score[ids[:, 3 + o : 3 + o + t], k] for k, o in enumerate(OFFSETS))


def allowed() -> np.ndarray:
    """0 where a label may follow another, a large negative number where not."""
    out = np.zeros((len(LABELS), len(LABELS)), np.float32)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                if a[2:] != b[2:]:
                    out[i, j] = -1e4
    return out


def viterbi(em: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels (B, T) of a batch, decoded together step by step."""
    b, t, n = em.shape
    back = np.zeros((b, t, n), np.int8)
    ban = np.array([0 if x[0] != "I" else -1e4 for x in LABELS], np.float32)
    best = em[:, 0] + ban
    for k in range(1, t):
        step = best[:, :, None] + trans
        back[:, k] = step.argmax(1)
        nxt = step.max(1) + em[:, k]
        # only differences matter; without this, long texts would outgrow the precision
        best = np.where((k < lengths)[:, None], nxt - nxt.max(1, keepdims=True), best)
    out = np.zeros((b, t), np.int8)
    rows = np.arange(b)
    last = best.argmax(1).astype(np.int8)
    for k in range(t - 1, -1, -1):
        here = k < lengths
        out[:, k] = np.where(here, last, 0)
        last = np.where(here, back[rows, k, last], last)
    return out


def _sum_by(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Rows of x summed by their index in ``at``."""
    order = np.argsort(at, kind="stable")
    found, starts = np.unique(at[order], return_index=True)
    out = np.zeros((n, x.shape[1]), x.dtype)
    out[found] = np.add.reduceat(x[order], starts, 0)
    return out


def expectations(em: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (B, T, L) and summed transition probabilities (L, L), by scaled forward and backward sums."""
    b, t, n = em.shape
    e = np.exp(em - em.max(2, keepdims=True)).astype(np.float64)
    step = np.exp(trans.astype(np.float64))
    e[:, 0, [x[0] == "I" for x in LABELS]] = 0
    fwd, back = np.empty((b, t, n)), np.ones((b, t, n))
    fwd[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for s in range(1, t):
        x = (fwd[:, s - 1] @ step) * e[:, s]
        x /= x.sum(1, keepdims=True)
        fwd[:, s] = np.where(mask[:, s, None], x, fwd[:, s - 1])
    pairs = np.zeros((n, n))
    for s in range(t - 2, -1, -1):
        ahead = e[:, s + 1] * back[:, s + 1]
        x = ahead @ step.T
        z = (fwd[:, s] * x).sum(1, keepdims=True)
        live = mask[:, s + 1]
        pairs += ((fwd[live, s] / z[live]).T @ ahead[live]) * step
        back[:, s] = np.where(live[:, None], x / x.sum(1, keepdims=True), 1)
    g = fwd * back
    return g / g.sum(2, keepdims=True), pairs


def train(
    texts: list[tuple[list[str], list[int]]], lexicon: dict[str, str], words: frozenset = frozenset(), epochs: int = 7, batch: int = 128, rate: float = 0.04, l2: float = 1e-5, least: int = 3, seed: int = 5
) -> Model:
    """Maximum likelihood by Adam over batches of texts of similar length.

    ``texts`` are (tokens, labels); features seen fewer than ``least`` times are left out.
    """
    r = np.random.default_rng(seed)
    kinds: dict[tuple[str, int], int] = {}
    # a part of the words is met as if it had never been seen, a part of the names as if the lexicon did not know them
    draw = iter(r.choice(3, size=sum(len(toks) for toks, _ in texts), p=MASKED).tolist())
    rows = [[kinds.setdefault((t, next(draw)), len(kinds) + 1) for t in toks] for toks, _ in texts]
    feats = [["edge"]] + [[f for f in features(t, lexicon, words, m > 0) if m < 2 or not f.startswith("lex")] for t, m in kinds]
    seen = Counter(f for toks in rows for i in toks for f in feats[i])
    seen["edge"] = least
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    nf, nl, no = len(index), len(LABELS), len(OFFSETS)
    ids = [[index[f] for f in fs if f in index] for fs in feats]
    width = max(map(len, ids))
    of = np.full((len(ids), width), nf)
    for i, x in enumerate(ids):
        of[i, : len(x)] = x
    w, tr = np.zeros((nf + 1, no * nl), np.float32), np.zeros((nl, nl), np.float32)
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)
    ban = allowed()
    order = sorted(range(len(texts)), key=lambda i: len(rows[i]))
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    mean_w, mean_t, kept, step = np.zeros_like(w), np.zeros_like(tr), 0, 0
    for epoch in range(epochs):
        for k in r.permutation(len(batches)):
            part = batches[k]
            t = max(len(rows[i]) for i in part)
            tok, y, mask = np.zeros((len(part), t + 6), int), np.zeros((len(part), t), int), np.zeros((len(part), t), bool)
            for j, i in enumerate(part):
                n = len(rows[i])
                tok[j, 3 : 3 + n], y[j, :n], mask[j, :n] = rows[i], texts[i][1], True
            used, inv = np.unique(tok, return_inverse=True)
            inv = inv.reshape(tok.shape)
            cols = of[used]
            em = emissions(w[cols].sum(1).reshape(len(used), no, nl), inv)
            g, gt = expectations(em, tr + ban, mask)
            g *= mask[..., None]
            np.subtract.at(g, (*np.nonzero(mask), y[mask]), 1)
            after = mask[:, 1:]
            np.add.at(gt, (y[:, :-1][after], y[:, 1:][after]), -1)
            gs = np.zeros((len(used), no, nl), np.float32)
            flat = g.reshape(-1, nl).astype(np.float32)
            for c, o in enumerate(OFFSETS):
                gs[:, c] = _sum_by(inv[:, 3 + o : 3 + o + t].ravel(), flat, len(used))
            gw = _sum_by(cols.ravel(), np.repeat(gs.reshape(len(used), -1), width, 0), nf + 1)
            gw[nf] = 0
            scale, lr, step = 1 / len(part), rate * (1 - epoch / epochs * 0.8), step + 1
            for x, grad, m1, m2 in ((w, gw * scale + l2 * w, mw, vw), (tr, gt * scale, mt, vt)):
                m1 += 0.1 * (grad - m1)
                m2 += 0.005 * (grad * grad - m2)
                x -= (lr / (1 - 0.9**step)) * m1 / (np.sqrt(m2 / (1 - 0.995**step)) + 1e-7)
            if 2 * epoch >= epochs:  # the weights of the second half are averaged
                mean_w += w
                mean_t += tr
                kept += 1
    weights = (mean_w[:nf] / kept).reshape(nf, no, nl).transpose(1, 0, 2)
    return Model(lexicon, index, np.ascontiguousarray(weights), mean_t / kept + ban, words)
