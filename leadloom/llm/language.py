"""Problem 8: which language a text, and each stretch of it, is in.

Segmentation-marginalised unigrams: each language has probabilities for the pieces of a fixed public vocabulary (a byte-level
BPE whose file is a parameter). The probability of a word is the sum over all its segmentations into pieces, by a forward
pass over its bytes; the words of a sentence are independent. A language can be written in Latin letters and otherwise, so
it has one distribution for words in Latin letters and one for others, and a probability of either. All are fitted by
expectation-maximisation over the same sums, on a bounded sample of labelled documents (``SAMPLE_PER_LABEL``); further
rounds fit again on only those sentences that the last model puts in the language of their label, so that wrong labels and
mixed texts do little harm.

A document's sentences are decoded together (Viterbi; changing the language costs ``SWITCH`` nats), so that lines without
evidence (names, addresses, prices) follow their neighbours. One state more stands for languages that the model does not
know: pieces by their rank in the vocabulary alone, which wins where no known language explains a text better.

Words repeat, so each task keeps the vectors of words it has met; new words, sentences and documents are worked on side by side.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Labelled documents that the model is fitted on, for each language: those of the smallest hashes.
SAMPLE_PER_LABEL = 1500
OVERSAMPLE = 4
EM_ROUNDS = 3
#: How often the sample is fitted, each time on the sentences that the last model agrees with.
FITS = 3
#: Share of the common distribution (all languages and single bytes) in each language's.
COMMON = 0.1
SWITCH = 3.0
#: A sentence tells a language if it has that many words with letters and its language leads by so many nats.
MIN_WORDS = 4
MIN_MARGIN = 4.0
#: A language keeps a rarer script if the model of the other half of the sample puts at least this share of the sentences so
#: labelled and written in that language: other languages explain the sentences that wrong labels and mixed texts bring, but not a script of its own.
LEAST_AGREED = 0.5
CACHE = 400_000
#: Documents are worked on together until they have so many characters.
BATCH_CHARS = 2_000_000
#: Words of more bytes are scored one by one, scaled at each byte.
LONG_WORD = 100
#: What no known language explains: its name, and how many nats a sentence in it starts behind.
OTHER = "und"
OTHER_HANDICAP = 8.0

#: The languages and the names they have in labels (ISO 639-1, 639-2, English name).
LANGUAGES = {
    "en": ("en", "eng", "english"),
    "hi": ("hi", "hin", "hindi"),
    "mr": ("mr", "mar", "marathi"),
    "ta": ("ta", "tam", "tamil"),
    "bn": ("bn", "ben", "bengali", "bangla"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "de": ("de", "deu", "ger", "german"),
}

_SENTENCE = re.compile(r"[^\n.!?।॥]+(?:[.!?।॥]+(?=\s|$)|[.!?।॥](?!\s|$)[^\n.!?।॥]*)*\s*|[\n.!?।॥]+\s*")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
#: Vowel signs and other marks that end words of Indic scripts.
_SIGNS = "ািীুूृेैोौंःँ্ா-்"


def label_code(label: Column) -> Column:
    """Two-letter code of a label in any notation (``en-IN``, ``eng``, ``English``), another lower-case name as it is for a
    language outside ``LANGUAGES``, null for null and for what names none (blank, ``und``, ``unknown``, signs)."""
    main = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)(?:[-_ ].*)?$", 1)
    c = F.when(main.isin("", "und", "unknown", "none", "null", "mul", "zxx", "mis", "other"), F.lit(None)).otherwise(main)
    for code, names in LANGUAGES.items():
        c = F.when(main.isin(*names), F.lit(code)).otherwise(c)
    return c


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences; together they cover the text."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def word_of(token: str) -> str:
    """What a token (no white space) is as a word: lower case, no signs at its ends; empty where it can tell no language,
    being without letters or having digits, dots or slashes inside (numbers, addresses, hosts)."""
    if not token.isalpha():
        if "@" in token or "/" in token or any(ch.isdigit() for ch in token):
            return ""
        token = token.lstrip("\"'([{«“‘-–—") if token[-1] in _SIGNS else _EDGE.sub("", token)
        if "." in token or not any(ch.isalpha() for ch in token):
            return ""
    return unicodedata.normalize("NFC", token).lower()


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """All pieces of a .tiktoken file, in its order."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Pieces:
    """The vocabulary for looking up the pieces that start at a place of a word."""

    def __init__(self, pieces: list[bytes]):
        self.index = {b: k for k, b in enumerate(pieces)}
        self.prefixes = {b[:n] for b in self.index for n in range(1, len(b) + 1)}

    def spans(self, word: bytes) -> list[tuple[int, int, int]]:
        """(start, end, piece) of every piece that occurs in ``word``."""
        out, n = [], len(word)
        for i in range(n):
            j = i + 1
            while j <= n and (x := word[i:j]) in self.prefixes:
                if (k := self.index.get(x)) is not None:
                    out.append((i, j, k))
                j += 1
        return out


def _bytes(word: str) -> bytes:
    return (" " + word).encode("utf-8", "replace")


class Lattice:
    """All segmentations of many words. Nodes are the places between bytes; the edges of all words are worked on together by
    their place in the word."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        size = np.array([len(b) + 1 for b in words], dtype=np.int64)
        self.first = np.cumsum(size) - size
        self.last = self.first + size - 1
        spans = [(w, i, j, k) for w, b in enumerate(words) for i, j, k in pieces.spans(b)]
        e = np.array(spans, dtype=np.int64).reshape(-1, 4)
        begin, end = self.first[e[:, 0]] + e[:, 1], self.first[e[:, 0]] + e[:, 2]
        self.nodes = int(size.sum())
        self.forward = self._levels(begin, end, e[:, 3], e[:, 2])
        self.backward = self._levels(end, begin, e[:, 3], -e[:, 1])

    @staticmethod
    def _levels(source: np.ndarray, target: np.ndarray, piece: np.ndarray, level: np.ndarray) -> list[tuple]:
        """(targets, where the edges of each begin, sources, pieces) of each level, in order."""
        order = np.lexsort((target, level))
        source, target, piece, level = source[order], target[order], piece[order], level[order]
        out, cuts = [], np.flatnonzero(np.diff(level, prepend=level[:1] - 1))
        for a, b in zip(cuts, np.append(cuts[1:], len(level))):
            heads = np.flatnonzero(np.diff(target[a:b], prepend=-1))
            out.append((target[a:b][heads], heads, source[a:b], piece[a:b]))
        return out

    def sums(self, levels: list[tuple], at: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Of each node, the sum over all ways from ``at`` to it; ``p``: a row a piece, a column a language."""
        out = np.zeros((self.nodes, p.shape[1]))
        out[at] = 1.0
        for targets, heads, sources, pieces in levels:
            out[targets] = np.add.reduceat(out[sources] * p[pieces], heads, axis=0)
        return out


def fit(counts: Counter, pieces: Pieces, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its word counts. (A word so long that its probability is no double adds nothing.)"""
    words = sorted(counts)
    x, c = Lattice([_bytes(w) for w in words], pieces), np.array([counts[w] for w in words], dtype=float)
    word_of_node = np.repeat(np.arange(len(words)), x.last - x.first + 1)
    p = np.zeros(len(pieces.index))
    for _, _, sources, ks in x.forward:  # start: every piece wherever it occurs, longer ones preferred
        np.add.at(p, ks, c[word_of_node[sources]])
    p *= np.array([len(b) for b in pieces.index])
    p /= max(p.sum(), 1.0)
    for _ in range(rounds):
        fwd, bwd = x.sums(x.forward, x.first, p[:, None])[:, 0], x.sums(x.backward, x.last, p[:, None])[:, 0]
        total = fwd[x.last]
        z = np.divide(c, total, out=np.zeros_like(c), where=total > 0)
        q = np.zeros(len(p))
        for targets, heads, sources, ks in x.forward:
            target = np.repeat(targets, np.diff(np.append(heads, len(sources))))
            np.add.at(q, ks, z[word_of_node[sources]] * fwd[sources] * p[ks] * bwd[target])
        p = q / max(q.sum(), 1.0)
    return p


def latin(word: str) -> int:
    """0 for a word that begins in Latin letters, else 1."""
    return 0 if ord(next((ch for ch in word if ch.isalpha()), "a")) < 0x250 else 1


class Words(dict):
    """Token -> (word, its script); an empty word for one that can tell no language. Each is looked at once."""

    def __missing__(self, token: str) -> tuple[str, int]:
        w = word_of(token)
        self[token] = found = (w, latin(w))
        return found

    def main(self, text: str) -> tuple[list[str], int]:
        """A sentence's words in the script that most of them are in (names in another script tell nothing), and the script."""
        ws = [x for t in text.split() if (x := self[t])[0]]
        script = int(2 * sum(k for _, k in ws) >= len(ws))
        return [w for w, k in ws if k == script], script


class Model:
    """Piece probabilities of all languages over the vocabulary, by script (0 Latin, 1 other)."""

    def __init__(self, pieces: "list[bytes] | Pieces", languages: list[str], tables: list[np.ndarray], prior: np.ndarray):
        """``tables``: for each script a row a piece and a column a language; ``prior``: log-probability of (script, language)."""
        self.languages, self.pieces, self.tables, self.prior = languages, pieces if hasattr(pieces, "prefixes") else Pieces(pieces), tables, prior
        self._clear()

    def _clear(self) -> None:
        """Forgets the tokens met: their numbers (0: can tell no language), and by number the script and the vector of each."""
        self.numbers: dict[str, int] = {}
        self.words: dict[str, int] = {"": 0}
        self.waiting: list[str] = []
        self.scripts = np.zeros(1, np.int64)
        self.vectors = np.zeros((1, len(self.languages)))

    def _number(self, token: str) -> int:
        """Of a token; a new word waits to be scored with others."""
        k = self.numbers.get(token)
        if k is None:
            w = word_of(token)
            k = self.words.get(w)
            if k is None:
                k = self.words[w] = len(self.words)
                self.waiting.append(w)
            self.numbers[token] = k
        return k

    @classmethod
    def of(cls, pieces: "Pieces", rows: pd.DataFrame) -> "Model":
        """From rows (code, script, piece, p); the row of piece -1 has the number of words that the distribution is fitted on.

        The last column is OTHER: the pieces by their rank alone."""
        languages = sorted(set(rows["code"]))
        if not languages:
            return cls(pieces, [], [np.zeros((len(pieces.index), 0))] * 2, np.zeros((2, 0)))
        column = {x: i for i, x in enumerate(languages)}
        byte = np.array([len(b) == 1 for b in pieces.index], dtype=float)
        rank = 1.0 / (np.arange(len(pieces.index)) + 100.0)
        tables, weights = [], np.ones((2, len(languages)))
        for script in (0, 1):
            part = rows[rows["script"] == script]
            total = part[part["piece"] < 0]
            np.add.at(weights[script], [column[x] for x in total["code"]], total["p"].to_numpy())
            part = part[part["piece"] >= 0]
            p = np.zeros((len(pieces.index), len(languages)))
            p[part["piece"].to_numpy(), [column[x] for x in part["code"]]] = part["p"].to_numpy()
            common = p @ (weights[script] / weights[script].sum())
            common = 0.9 * common + 0.1 * byte / max(byte.sum(), 1.0)
            tables.append(np.hstack([(1 - COMMON) * p + COMMON * common[:, None], (rank / rank.sum())[:, None]]))
        prior = np.log(weights / weights.sum())
        return cls(pieces, [*languages, OTHER], tables, np.hstack([prior, prior.max(axis=1, keepdims=True) - OTHER_HANDICAP]))

    def _score(self) -> None:
        """Log-probabilities of the words that wait, in each language, by the forward sums over all segmentations."""
        words, self.waiting = self.waiting, []
        if not words:
            return
        scripts = np.array([latin(w) for w in words], dtype=np.int64)
        out = np.zeros((len(words), len(self.languages)))
        raw = [_bytes(w) for w in words]
        for script in (0, 1):
            which = [k for k in np.flatnonzero(scripts == script).tolist() if len(raw[k]) <= LONG_WORD]
            if which:
                x = Lattice([raw[k] for k in which], self.pieces)
                out[which] = np.log(np.maximum(x.sums(x.forward, x.first, self.tables[script])[x.last], 1e-300))
        for k, b in enumerate(raw):
            if len(b) > LONG_WORD:
                out[k] = self._long(b, self.tables[scripts[k]])
        self.scripts, self.vectors = np.concatenate([self.scripts, scripts]), np.concatenate([self.vectors, out])

    def _long(self, b: bytes, table: np.ndarray) -> np.ndarray:
        """Of one word of any length: the same sums, scaled to 1 at each byte, with the logarithms of the scales added up."""
        ends: dict[int, list[tuple[int, int]]] = {}
        for i, j, k in self.pieces.spans(b):
            ends.setdefault(j, []).append((i, k))
        fwd, scale = {0: np.ones(table.shape[1])}, {0: np.zeros(table.shape[1])}
        for j in range(1, len(b) + 1):
            pairs = ends.get(j, [])
            top = np.max([scale[i] for i, _ in pairs], axis=0) if pairs else scale[j - 1]
            v = sum((fwd[i] * table[k] * np.exp(scale[i] - top) for i, k in pairs), np.zeros(table.shape[1]))
            unit = np.where(v > 0, v, 1.0)
            fwd[j], scale[j] = v / unit, top + np.log(unit)
            if j >= 1000 and j % 1000 == 0:  # no piece is so long
                for i in [i for i in fwd if i < j - 500]:
                    del fwd[i], scale[i]
        return np.where(fwd[len(b)] > 0, scale[len(b)], np.log(1e-300))

    def word(self, w: str) -> np.ndarray:
        """Log-probability of a word in each language."""
        k = self._number(w)
        self._score()
        return self.vectors[k]

    def rows(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each sentence, its log-probability in each language, of the words in the script that most of them are in (names in
        another script tell nothing) and of that script; and how many words these are. Zeros for no words."""
        get, tokens, sizes = self._number, [], []
        for x in parts:
            t = x.split()
            tokens += t
            sizes.append(len(t))
        ids = np.fromiter(map(get, tokens), np.int64, len(tokens))
        self._score()
        owner = np.repeat(np.arange(len(parts)), sizes)[ids > 0]
        ids = ids[ids > 0]
        script, n = self.scripts[ids], np.bincount(owner, minlength=len(parts))
        main = (2 * np.bincount(owner, weights=script, minlength=len(parts)) >= n).astype(np.int64)
        keep = script == main[owner]
        owner, ids = owner[keep], ids[keep]
        out, words = np.zeros((len(parts), len(self.languages))), np.bincount(owner, minlength=len(parts))
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(heads):
            out[owner[heads]] = np.add.reduceat(self.vectors[ids], heads, axis=0) + self.prior[main[owner[heads]]]
        return out, words

    def kept(self, texts: list[str], language: str | None) -> list[tuple[list[str], int, bool]]:
        """(words, script, whether ``language`` is the best; true for None) of each sentence of ``texts`` that has words."""
        parts = [t[a:b] for t in texts for a, b in sentences(t)]
        good = np.ones(len(parts), bool)
        if language is not None:
            s, _ = self.rows(parts)
            good = s[:, self.languages.index(language)] >= s.max(axis=1)
        memo = Words()
        return [(*found, bool(x)) for part, x in zip(parts, good) if (found := memo.main(part))[0]]

    def segments(self, text: str | None) -> list[tuple[int, int, str, float, int]]:
        """``each`` for one text."""
        return self.each([text])[0]

    def each(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float, int]]]:
        """For each text, (start, end, language, confidence, sentences that tell it) of each stretch in one language; none if nothing
        tells a language. The language is OTHER where no known one explains the stretch.

        ``confidence`` is the posterior probability that all sentences of the stretch are in the language, all sequences of
        languages being weighted by the sentences and by SWITCH for each change (forward-backward over the whole text).
        """
        out: list[list] = [[] for _ in texts]
        spans = {d: sentences(t) for d, t in enumerate(texts) if t}
        if not self.languages or not spans:
            return out
        if len(self.words) > CACHE:
            self._clear()
        docs = sorted(spans, key=lambda d: -len(spans[d]))  # those with a sentence number r are the first ones
        s, words = self.rows([texts[d][a:b] for d in docs for a, b in spans[d]])
        size = np.array([len(spans[d]) for d in docs])
        start = np.cumsum(size) - size
        path, alpha, beta = self._decode(s, start, size)
        total = np.logaddexp.reduce(alpha[start + size - 1], axis=1)
        known = len(self.languages) - 1
        at = np.arange(len(s))
        others = s[:, :known].copy()
        others[at[path < known], path[path < known]] = -np.inf
        tells = (words >= MIN_WORDS) & (path < known)
        margin = s[at, path] - others.max(axis=1, initial=-np.inf)
        new = np.ones(len(s), bool)
        new[1:] = path[1:] != path[:-1]
        new[start] = True
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(s)) - 1
        # all sentences of a stretch in its language: into its first, stays, out of its last
        inner = np.append(0, np.cumsum(s[at, path]))
        doc = np.searchsorted(start, heads, side="right") - 1
        sure = np.exp(np.minimum(0.0, alpha[heads, path[heads]] + inner[tails + 1] - inner[heads + 1] + beta[tails, path[tails]] - total[doc]))
        count = np.add.reduceat((tells & (margin >= MIN_MARGIN)).astype(int), heads)
        size_of = np.add.reduceat(words, heads)
        lead = np.add.reduceat(np.where(path < known, s[at, path], 0.0), heads)
        for k, (h, t, d) in enumerate(zip(heads.tolist(), tails.tolist(), doc.tolist())):
            a, b = spans[docs[d]][h - start[d]][0], spans[docs[d]][t - start[d]][1]
            out[docs[d]].append((a, b, self.languages[path[h]], float(sure[k]), int(count[k]), int(size_of[k]), h, t))
        for d, found in enumerate(out):
            if found and not any(x[4] for x in found):  # nothing leads clearly: the stretch of most words stands for the text
                k = max(range(len(found)), key=lambda i: found[i][5])
                _, _, lang, _, _, n, h, t = found[k]
                if lang != OTHER and n and (n >= MIN_WORDS or _lead(s[h : t + 1, :known].sum(axis=0)) >= MIN_MARGIN):
                    found[k] = (*found[k][:4], 1)
            out[d] = [x[:5] for x in found]
        return out

    @staticmethod
    def _decode(s: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best path, and the logarithms of the forward and backward sums, of texts (longest first) side by side."""
        stay, change = np.log1p(-np.exp(-SWITCH)), -SWITCH
        n, most = s.shape[1], int(size[0])
        active = [int(np.searchsorted(-size, -r, side="left")) for r in range(most + 1)]  # texts with more than r sentences
        path, back, alpha, beta = np.zeros(len(s), np.int64), np.zeros(s.shape, np.int16), s.copy(), np.zeros(s.shape)
        best = s[start].copy()
        every = np.arange(n)
        for r in range(1, most):
            k = active[r]
            at = start[:k] + r
            top = best[:k].argmax(axis=1)
            moved = best[np.arange(k), top] - SWITCH
            back[at] = np.where(best[:k] >= moved[:, None], every, top[:, None])
            best[:k] = np.maximum(best[:k], moved[:, None]) + s[at]
            a = alpha[at - 1]
            alpha[at] = s[at] + np.logaddexp(a + stay, np.logaddexp.reduce(a, axis=1, keepdims=True) + change)
        path[start + size - 1] = best.argmax(axis=1)
        for r in range(most - 2, -1, -1):
            at = start[: active[r + 1]] + r
            path[at] = back[at + 1, path[at + 1]]
            b = s[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(b + stay, np.logaddexp.reduce(b, axis=1, keepdims=True) + change)
        return path, alpha, beta


def _lead(row: np.ndarray) -> float:
    """By how much the best leads."""
    two = np.sort(row)[-2:]
    return float(two[-1] - two[0]) if len(row) > 1 else np.inf


def batches(ids, texts) -> Iterator[tuple[list, list]]:
    """Texts until they have BATCH_CHARS characters together."""
    some, parts, size = [], [], 0
    for d, t in zip(ids, texts):
        some.append(d)
        parts.append(t)
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield some, parts
            some, parts, size = [], [], 0
    if some:
        yield some, parts


def _fit_frame(pieces: Broadcast, old: Model | None, cleared: set[tuple[str, int]]):
    """Fits a language on the sentences of ``pdf`` (code, half, text) that ``old`` puts in it, without the ``cleared`` scripts."""
    packed = old and (old.languages, old.tables, old.prior)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shared, lang, counts = pieces.value, pdf["code"].iloc[0], (Counter(), Counter())
        model = Model(shared, *packed) if packed else Model(shared, [], [], np.zeros((2, 0)))
        for _, texts in batches(pdf["text"], pdf["text"]):
            for ws, script, good in model.kept(texts, lang if packed else None):
                if good and (lang, script) not in cleared:
                    counts[script].update(ws)
        out = []
        for script in (0, 1):
            p = fit(counts[script], shared)
            k = np.flatnonzero(p > 1e-9)
            out.append(pd.DataFrame({"code": lang, "script": script, "piece": np.append(k, -1).astype("int64"), "p": np.append(p[k], counts[script].total())}))
        return pd.concat(out)

    return run


def _agreement_frame(pieces: Broadcast, others: dict[int, Model]):
    """(code, script, said, agreed): sentences of a language's sample in each script, and how many of them the model of the other
    half puts in the language."""
    packed = {half: (m.languages, m.tables, m.prior) for half, m in others.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shared, lang, said, agreed = pieces.value, pdf["code"].iloc[0], [0, 0], [0, 0]
        for half, part in pdf.groupby("half"):
            other = Model(shared, *packed[int(half)])
            for _, texts in batches(part["text"], part["text"]):
                for _, script, good in other.kept(texts, lang if lang in other.languages else None):
                    said[script] += 1
                    agreed[script] += good
        return pd.DataFrame({"code": lang, "script": [0, 1], "said": said, "agreed": agreed})

    return run


def sample(documents: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """(code, half, text): for each language the different labelled texts of the smallest hashes, whole.

    Of a language with many documents only hashes below a bound (some ``OVERSAMPLE`` times what is wanted) are looked at, so
    that texts are neither compared nor moved beyond that.
    """
    x = documents.select(label_code(F.col("lang")).alias("code"), "text").where(F.col("code").isin(*LANGUAGES) & (F.length("text") > 0))
    most = x.groupBy("code").agg(F.count("*").alias("n")).collect()  # one row a language
    x = x.withColumn("h", F.xxhash64("text"))
    share = F.lit(0.0)
    for r in most:
        share = F.when(F.col("code") == r.code, F.lit(min(1.0, OVERSAMPLE * per_label / r.n))).otherwise(share)
    x = x.where(F.col("h") <= (share * 2.0 - 1.0) * float((1 << 63) - 1025)).select("code", "h", "text")
    rank = F.row_number().over(Window.partitionBy("code").orderBy("h"))
    return x.dropDuplicates(["code", "h"]).withColumn("rank", rank).where(F.col("rank") <= per_label).select("code", F.pmod("h", F.lit(2)).cast("int").alias("half"), "text")


def train(documents: DataFrame, vocabulary: str = VOCABULARY, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """A model of the languages that occur as labels. What is collected is bounded by languages x vocabulary."""
    pieces = read_vocabulary(vocabulary)
    chosen, model = cut(sample(documents, per_label)), None
    shared = documents.sparkSession.sparkContext.broadcast(Pieces(pieces))  # a Python worker unpacks it once

    def fitted(rows: DataFrame, old: Model | None, cleared: set) -> Model:
        found = rows.groupBy("code").applyInPandas(_fit_frame(shared, old, cleared), "code string, script int, piece bigint, p double").toPandas()
        return Model.of(shared.value, found.sort_values(["code", "script", "piece"]))

    # a model agrees with what it was fitted on, so which scripts a language has is judged by the model of the other half
    halves = {half: fitted(chosen.where(F.col("half") == 1 - half), None, set()) for half in (0, 1)}
    said = chosen.groupBy("code").applyInPandas(_agreement_frame(shared, halves), "code string, script int, said bigint, agreed bigint").toPandas()
    most = said.groupby("code")["said"].transform("max")
    rare = said[(said["said"] < most) & (said["agreed"] < LEAST_AGREED * said["said"])]
    cleared = set(zip(rare["code"], rare["script"].astype(int)))
    for _ in range(FITS):
        model = fitted(chosen, model, cleared)
    return model


def segments(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang, confidence, sentences) of every document, whole texts. Null and empty texts, and texts
    without words, have no rows. Positions are in characters."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast((model.pieces, model.languages, model.tables, model.prior))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for f in frames:
            for ids, texts in batches(f["doc_id"], f["text"]):
                rows = [(d, *x) for d, found in zip(ids, m.each(texts)) for x in found]
                yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "lang", "confidence", "sentences"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, start bigint, end bigint, lang string, confidence double, sentences bigint")


def languages_of(found: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence): the languages that at least one full sentence of the document is in (OTHER is none)."""
    return found.where("sentences > 0").where(F.col("lang") != OTHER).groupBy("doc_id", "lang").agg(F.max("confidence").alias("confidence"))


def relabel(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence) of documents whose label is missing or names none of the text's languages, and of
    documents in more than one language: one row per language."""
    labels = documents.select("doc_id", label_code(F.col("lang")).alias("label"))
    langs = languages_of(found).groupBy("doc_id").agg(F.collect_list(F.struct("lang", "confidence")).alias("langs"))
    x = labels.join(langs, "doc_id")
    wrong = F.col("label").isNull() | ~F.exists("langs", lambda s: s["lang"] == F.col("label"))
    return x.where(wrong | (F.size("langs") > 1)).select("doc_id", F.explode("langs").alias("s")).select("doc_id", "s.lang", "s.confidence")
