"""Toxicity by noisy-channel deobfuscation and a linear score of the restored text.

1. A character trigram model is counted over all texts (one pass, 2^15 sums); no trigram crosses from
   one text into the next, so it does not depend on how rows lie in partitions.
2. Places that may hide a word (letters mixed with look-alike signs, letters repeated, single letters
   or signs in a row of which one is a letter) become lattices: each sign may stand for itself or for
   the letters that it resembles, each repetition may be dropped, each gap may be closed. Viterbi
   decoding under the trigram model picks the text that was meant. Spots have no longest length;
   equal spots of a batch are decoded once.
3. Features are hashed words and word beginnings of the restored text. Those that tell the two
   labels apart are selected by log-likelihood ratio; a logistic regression weighs them.

Labels are learned from at most ``MAX_LABELS`` labelled rows (those with the lowest hashes), from
none of which the crc32 of the id is divisible by 5. Ids, languages, sources and labels are no features.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _power_tables, arrow, chunks, cut, fresh, mix, string_bytes, trimmed, word_spans

#: Labelled rows from which the classifier is fitted, at most.
MAX_LABELS = 100_000
#: Hashed features, and how many of them the regression uses.
BUCKETS, SELECTED = 1 << 18, 1024
#: Bytes of a word's beginnings that are features besides the whole word.
PREFIXES = (4, 6, 8, 10)
CHUNK = 1 << 20
#: Characters of the longest spots whose readings are remembered; longer ones are decoded each time.
REMEMBERED = 80

#: Letters that a sign resembles.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
#: Costs (negative logarithms) of the channel: a sign for a letter, a dropped repetition, a closed
#: gap, a sign that stands for itself, a repetition that was meant, and, where neither a sign nor a row
#: of three says that a word is disguised, a dropped letter of a pair.
SWAP, DROP, CLOSE, KEEP_SIGN, KEEP_REPEAT, UNPAIR = 0.7, 0.3, 0.1, 4.0, 2.0, 4.0
#: Gap characters between spaced symbols, at most, and symbols of a spaced run, at least.
WIDEST_GAP, SPACED = 2, 4

# symbols of the trigram model: 0 space and all else, 1-26 a-z, 27 digit, 28 any byte above 127
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[48:58] = 27
_SYMBOL[128:] = 28
SYMBOLS = 32

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKS]] = True
_BREAK = np.ones(256, bool)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _BREAK[_a:_b] = False

_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_GAPS = " .-*_"
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in _GAPS]] = True

_SIGNS = "".join(re.escape(c) for c in LOOKS)
#: Where this occurs, a character's second occurrence is doubtful; elsewhere (class!, a$$) only in a row of three.
_INSIDE = re.compile(rf"[{_SIGNS}][a-z]|([a-z])\1\1")


# ---------------------------------------------------------------- language model


def _count_trigrams(batches):
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        data, off = string_bytes(batch.column(0))
        for a, b in chunks(off, CHUNK):
            s = _SYMBOL[data[off[a] : off[b]]]
            if len(s) > 2:
                own = np.ones(len(s), bool)
                ends = off[a + 1 : b] - off[a]
                for back in (1, 2):
                    own[ends[ends >= back] - back] = False
                total += np.bincount(((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])[own[:-2]], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"code": at.astype(np.int64), "n": total[at]})


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs of a symbol after two others, from all texts, smoothed by the shorter contexts."""
    rows = docs.select("text").transform(arrow, _count_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    c = np.zeros(SYMBOLS**3)
    for r in rows:  # at most 2^15
        c[r["code"]] = r["n"]
    c = c.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (c.sum((0, 1)) + 1) / (c.sum() + SYMBOLS)
    two = (c.sum(0) + 20 * one) / (c.sum((0, 2))[:, None] + 20)
    return -np.log((c + 20 * two[None]) / (c.sum(2)[:, :, None] + 20))


def readings(spot: str) -> list[list[tuple[str, float]]]:
    """What each character of a spot may stand for, with the channel's cost: the lattice."""
    end, inside, out = len(spot.rstrip("!")), bool(_INSIDE.search(spot)), []
    for i, ch in enumerate(spot):
        again = i > 0 and ch == spot[i - 1]
        doubtful = again and (inside or 3 * ch in spot[max(i - 2, 0) : i + 3])
        if i > end:
            out.append([("", 0.0)])  # of several last ! one says as much
        elif "a" <= ch <= "z":
            out.append([(ch, KEEP_REPEAT if doubtful else 0.0)] + [("", DROP if doubtful else UNPAIR)] * again)
        elif ch in _GAPS:
            out.append([("", CLOSE), (ch, 0.0)])
        else:
            # a last ! is punctuation as well
            out.append([(x, SWAP) for x in LOOKS[ch]] + [(ch, KEEP_SIGN if i < end else 0.0)] + [("", DROP)] * doubtful)
    return out


def symbol(out: str) -> int:
    return ord(out) - 96 if "a" <= out <= "z" else 27 if out.isdigit() else 0


class Decoder:
    """Viterbi decoding of a spot's lattice."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.decode = lru_cache(maxsize=20_000)(self._decode)

    def read(self, spot: str) -> str:
        """A spot of any length decoded; only short ones are remembered."""
        return self.decode(spot) if len(spot) <= REMEMBERED else self._decode(spot)

    def _decode(self, spot: str) -> str:
        # state: the last two symbols; value: cost, and what was put out as a chain from the last sign back,
        # so that the time is linear in the spot's length
        states: dict = {(0, 0): (0.0, None)}
        for choices in readings(spot):
            new: dict = {}
            for (p, q), (cost, chain) in states.items():
                for out, price in choices:
                    if out:
                        s = symbol(out)
                        key, value = (q, s), (cost + price + self.costs[p][q][s], (chain, out))
                    else:
                        key, value = (p, q), (cost + price, chain)
                    if key not in new or value[0] < new[key][0]:
                        new[key] = value
            states = new
        chain = min(((cost + (self.costs[p][q][0] if q else 0.0), chain) for (p, q), (cost, chain) in states.items()), key=lambda x: x[0])[1]
        text = []
        while chain is not None:
            chain, out = chain
            text.append(out)
        return "".join(reversed(text))

    def restore(self, text: str) -> str:
        """A lower-cased text with its spots decoded."""
        return restored(pa.array([text], pa.string()), self)[0].as_py()


def spots(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in order and apart, of the places in lower-cased texts that become lattices: runs of
    letters and signs that hold a letter and either a sign or a letter twice in a row, and SPACED or
    more single letters or signs with gaps between them, a letter among them."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none
    letter, sign = _LETTER[data], _SIGN[data]
    live = letter | sign
    first = np.zeros(n + 1, bool)  # where texts begin
    first[off] = True
    begin = live.copy()
    begin[1:] &= ~live[:-1] | first[1:n]
    stop = live.copy()
    stop[:-1] &= ~live[1:] | first[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if not len(s):
        return none, none
    pair = np.zeros(n, bool)
    pair[1:] = letter[1:] & (data[1:] == data[:-1]) & ~first[1:n]
    letters, marks = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, sign | pair))
    word = (letters[e] > letters[s]) & (marks[e] > marks[s])
    # single symbols, not part of a word, with nothing but a gap to the next one
    inside = np.concatenate([[False], ~_BREAK[data], [False]])
    inside_before, inside_after = inside[s] & ~first[s], inside[e + 1] & ~first[e]
    single = (e - s == 1) & ~inside_before & ~inside_after
    gaps = np.concatenate([[0], np.cumsum(_GAP[data])])
    width = s[1:] - e[:-1]
    texts = np.searchsorted(off, s, side="right")
    linked = single[:-1] & single[1:] & (width > 0) & (width <= WIDEST_GAP) & (gaps[s[1:]] - gaps[e[:-1]] == width) & (texts[1:] == texts[:-1])
    run = np.cumsum(np.concatenate([[True], ~linked]))
    low = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    high = np.append(low[1:], len(s)) - 1
    wide = (high - low + 1 >= SPACED) & (letters[e[high]] > letters[s[low]])
    covered = np.zeros(len(s) + 1, np.int64)
    covered[low[wide]] += 1
    covered[high[wide] + 1] -= 1
    alone = np.flatnonzero(word & (np.cumsum(covered)[:-1] == 0))
    starts = np.concatenate([s[alone], s[low[wide]]])
    ends = np.concatenate([e[alone], e[high[wide]]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def restored(column, decoder: Decoder):
    """A text column, lower-cased, with its spots decoded; nulls are empty."""
    low = pc.utf8_lower(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null("")
    data, off = string_bytes(low)
    changed: dict[int, list] = {}
    for a, b in chunks(off, CHUNK):
        d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        s, e = spots(d, o)
        if not len(s):
            continue
        up, down = _power_tables(len(d) + 1)
        c = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(_VALUES[d] * up[: len(d)], out=c[1:])
        _, one, which = np.unique(mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64)), return_index=True, return_inverse=True)
        new = []
        for x, y in zip(s[one].tolist(), e[one].tolist()):
            raw = d[x:y].tobytes()
            read = decoder.read(raw.decode()).encode()
            new.append(read if read != raw else None)
        differs = np.array([x is not None for x in new])
        for k in np.flatnonzero(differs[which]).tolist():
            row = int(np.searchsorted(o, s[k], side="right")) - 1
            changed.setdefault(a + row, []).append((int(s[k] - o[row]), int(e[k] - o[row]), new[which[k]]))
    if not changed:
        return low
    fixed = []
    for row, edits in sorted(changed.items()):
        raw, at, parts = data[off[row] : off[row + 1]].tobytes(), 0, []
        for x, y, read in edits:
            parts += [raw[at:x], read]
            at = y
        fixed.append(b"".join([*parts, raw[at:]]).decode())
    mask = np.zeros(len(low), bool)
    mask[list(changed)] = True
    return pc.replace_with_mask(low, pa.array(mask), pa.array(fixed, low.type))


# ---------------------------------------------------------------- features


def features(column):
    """Yields (first row, feature of each occurrence, its row, words per row) of lower-cased texts."""
    data, off = string_bytes(column)
    for a, b in chunks(off, CHUNK):
        d = data[off[a] : off[b]]
        s, e, per = word_spans(d, off[a : b + 1] - off[a], _BREAK)
        up, down = _power_tables(len(d) + 1)
        c = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(_VALUES[d] * up[: len(d)], out=c[1:])
        row = np.repeat(np.arange(b - a), np.diff(per))
        found, rows = [mix((c[e] - c[s]) * down[s] + np.uint64(77))], [row]
        for n in PREFIXES:
            long = e - s > n
            t = s[long]
            found.append(mix((c[t + n] - c[t]) * down[t] + np.uint64(n)))
            rows.append(row[long])
        yield a, (np.concatenate(found) >> np.uint64(46)).astype(np.int64), np.concatenate(rows), np.diff(per)


def _count_features(decoder):
    def run(batches):
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), np.int64)
            for a, f, row, per in features(restored(batch.column(0), decoder.value)):
                u = np.unique(row * BUCKETS + f)
                r, f = u // BUCKETS, u % BUCKETS
                for label in (0, 1):
                    seen[label] += np.bincount(f[y[a + r] == label], minlength=BUCKETS)
        at = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_pydict({"f": at, "no": seen[0][at], "yes": seen[1][at]})

    return run


def _vectors(text, decoder, place):
    """(row, selected feature, its count) triples and words per row of each chunk, by row and feature."""
    for a, f, row, per in features(restored(text, decoder)):
        p = place[f]
        on = p >= 0
        u, n = np.unique(row[on] * SELECTED + p[on], return_counts=True)
        yield a, u // SELECTED, u % SELECTED, np.minimum(n, 65535).astype(np.uint16), per


def _values(counts, words, lengths) -> np.ndarray:
    """Values of features from their counts and the words of their rows."""
    return np.log1p(counts.astype(np.float32)) * np.repeat((4.0 / np.log(10 + words)).astype(np.float32), lengths)


def _collect_vectors(decoder, place):
    def run(batches):
        for batch in batches:
            for a, r, f, v, per in _vectors(batch.column(0), decoder.value, place.value):
                cut = np.searchsorted(r, np.arange(len(per) + 1))
                f = f.astype(np.uint16)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch.column(2).slice(a, len(per)),
                        "y": batch.column(1).slice(a, len(per)).cast(pa.int32()),
                        "words": per.astype(np.int64),
                        "f": [f[x:z].tobytes() for x, z in zip(cut, cut[1:])],
                        "v": [v[x:z].tobytes() for x, z in zip(cut, cut[1:])],
                    },
                    schema=pa.schema([("key", pa.int64()), ("y", pa.int32()), ("words", pa.int64()), ("f", pa.binary()), ("v", pa.binary())]),
                )

    return run


def _shorts(column) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit numbers of a binary column in one array, and how many each row has."""
    data, lengths = [], []
    for chunk in column.chunks:
        off = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(off) > 1 and off[-1] > off[0]:
            data.append(np.frombuffer(chunk.buffers()[2], np.uint8)[off[0] : off[-1]].copy().view(np.uint16))
        lengths.append(np.diff(off) // 2)
    return np.concatenate(data) if data else np.zeros(0, np.uint16), np.concatenate(lengths) if lengths else np.zeros(0, np.int64)


def _logistic(col, val, lengths, y, rounds: int = 400, l2: float = 2e-5, part: int = 1 << 19):
    """Weights and bias by full-batch Adam; deterministic. Rows are taken in parts, so that besides the
    vectors themselves (6 bytes a value) only a part's temporaries are held."""
    w, n = np.zeros(SELECTED + 1), len(y)
    m, s = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    off = np.concatenate([[0], np.cumsum(lengths)])
    parts = list(chunks(off, part))
    for t in range(1, rounds + 1):
        grad, bias = np.zeros(SELECTED), 0.0
        for a, b in parts:
            c, v, k = col[off[a] : off[b]], val[off[a] : off[b]], lengths[a:b]
            sums = np.concatenate([[0.0], np.cumsum(v * w[c])])
            z = sums[off[a + 1 : b + 1] - off[a]] - sums[off[a:b] - off[a]] + w[-1]
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]
            grad += np.bincount(c, v * np.repeat(g, k), minlength=SELECTED)
            bias += g.sum()
        grad = np.append(grad / n + l2 * w[:-1], bias / n)
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return w


class Model:
    def __init__(self, decoder: Decoder, place: np.ndarray, weights: np.ndarray):
        self.decoder, self.place, self.weights = decoder, place, weights

    def scores(self, text) -> np.ndarray:
        out = np.zeros(len(text))
        for a, r, f, n, per in _vectors(text, self.decoder, self.place):
            v = _values(n, per, np.bincount(r, minlength=len(per)))
            z = np.bincount(r, v * self.weights[f], minlength=len(per)) + self.weights[-1]
            out[a : a + len(per)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out

    def __getstate__(self):
        return self.decoder.costs, self.place, self.weights

    def __setstate__(self, state):
        self.decoder, self.place, self.weights = Decoder(np.array(state[0])), state[1], state[2]


class _Shared:
    """A decoder that each worker builds once."""

    def __init__(self, costs):
        self._costs, self._decoder = costs, None

    @property
    def value(self) -> Decoder:
        if self._decoder is None:
            self._decoder = Decoder(self._costs.value)
        return self._decoder

    def __getstate__(self):
        return self._costs

    def __setstate__(self, costs):
        self._costs, self._decoder = costs, None


def held_out(doc_id):
    """True for rows that are never learned from; also for rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """A model from the texts of ``docs`` and the labels (doc_id, toxic) of rows not held out.

    The driver holds 2^18 sums of features and the selected features of ``max_labels`` rows, 6 bytes
    each; both are bounded whatever the input's size, and given back when the weights are known.
    """
    sc = docs.sparkSession.sparkContext
    costs = sc.broadcast(language_model(docs))
    decoder = _Shared(costs)
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    chosen = cut(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y", F.xxhash64("doc_id").alias("key"))
    counts = train.select("text", "y").transform(arrow, _count_features(decoder), "f long, no long, yes long").groupBy("f").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    # the strongest features by log-likelihood ratio against independence; 2^18 rows at most
    table = counts.toArrow()
    by = np.argsort(table["f"].to_numpy())
    place = np.full(BUCKETS, -1, np.int64)
    rows = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(rows) < 2 or not len(by):
        weights = np.zeros(SELECTED + 1)
        weights[-1] = 3.0 if 1 in rows and 0 not in rows else -3.0
        return _finished([costs], Model(Decoder(costs.value), place, weights))
    f, a, b = (table[x].to_numpy()[by] for x in ("f", "yes", "no"))
    a, b = a.astype(float), b.astype(float)
    yes, no = max(rows[1], a.max()), max(rows[0], b.max())

    def part(x, e):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0)

    p = (a + b) / (yes + no)
    ratio = part(a, yes * p) + part(b, no * p) + part(yes - a, yes * (1 - p)) + part(no - b, no * (1 - p))
    ratio[a + b < 3] = 0
    best = np.argsort(-ratio, kind="stable")[:SELECTED]
    best = best[ratio[best] > 4]
    place[f[best]] = np.arange(len(best))
    del table, by, f, a, b, p, ratio
    places = sc.broadcast(place)
    # in an order of its own, so that sums of fractions do not depend on partitions
    got = cut(train.transform(arrow, _collect_vectors(decoder, places), "key long, y int, words long, f binary, v binary")).orderBy("key", "words", "f", "v").toArrow()
    col, lengths = _shorts(got["f"])
    val = _values(_shorts(got["v"])[0], got["words"].to_numpy(), lengths)
    y = got["y"].to_numpy().astype(float)
    del got
    weights = _logistic(col, val, lengths, y)
    del col, val, lengths, y
    return _finished([costs, places], Model(Decoder(costs.value), place, weights))


def _finished(shared: list, model: Model) -> Model:
    for b in shared:
        b.unpersist()
    trimmed()
    return model


def _score(model, name: str):
    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            s = pa.array(model.value.scores(text), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, s], names=[*batch.schema.names, name])

    return run


def scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with a column ``name``, the probability that its text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.transform(arrow, _score(shared, name), docs.withColumn(name, F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without features. Rows without an id are scored and
    count as held out. Where no labelled rows of both kinds can be learned from, all scores are alike
    (below 0.5 unless all labels are 1). Repeated labels of an id count as toxic if one of them does.
    """
    s = scored(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (columns doc_id, text and any others) that are not predicted toxic, with
    their columns. Null and empty texts stay unless every label is 1; repeated rows stay or go
    together; an empty table gives an empty result."""
    name = fresh(docs, "score")
    return scored(docs, fit(docs, labels), name).where(F.col(name) < 0.5).drop(name)
