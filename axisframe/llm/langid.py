"""Language of words and documents by a linear-chain conditional random field."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import IS_SPACE, LOWER, U, Words, release, slices, tidy

#: Documents of each language that the field is fitted on (about, by a hash of the id), and the most characters that
#: such a document may have. Word counts of the lexicon come from all documents with a language.
TRAIN_ROWS = 200
TRAIN_CHARS = 20_000
EPOCHS = 3
#: Words of a block: all blocks of a batch are gone through at once, and messages pass exactly from one to the next.
BLOCK = 256
#: Bytes of a text that are held with their features at a time; a longer one is gone through in such parts, twice.
PART = 2_000_000
#: Buckets of each hashed feature table and of the lexicon.
BUCKETS = 1 << 16
LEXICON = 1 << 14
UNKNOWN = "und"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Features:
    """Feature buckets of the words of a column: byte trigrams across word edges, affixes of three bytes, the word."""

    def __init__(self, texts: pa.Array):
        w = self.words = Words(texts)
        n = len(w.buf)
        low = LOWER[w.buf].astype(np.uint32)
        low[IS_SPACE[w.buf]] = 32
        before, after = np.full(n, 32, np.uint32), np.full(n, 32, np.uint32)
        before[1:], after[:-1] = low[:-1], low[1:]
        before[w.start], after[w.end - 1] = 32, 32
        code = (before << np.uint32(16)) | (low << np.uint32(8)) | after
        with np.errstate(over="ignore"):
            self.grams = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
            third = np.minimum(w.start + 2, w.end - 1)
            head = (code[w.start] << np.uint32(8)) ^ low[third]
            tail = (code[w.end - 1] << np.uint32(8)) ^ low[np.maximum(w.end - 3, w.start)] ^ np.uint32(0x5BD1E995)
            self.heads = ((head * np.uint32(2246822519)) >> np.uint32(16)).astype(np.int64)
            self.tails = ((tail * np.uint32(3266489917)) >> np.uint32(16)).astype(np.int64)
        self.lexicon = (w.hashes() & U(LEXICON - 1)).astype(np.int64)
        c = np.concatenate([[0], np.cumsum(_LETTER[w.buf])])
        self.lettered = c[w.end] > c[w.start]
        #: Where each text's chain of words begins, end last; texts without words have none.
        self.chains = np.append(w.first[:-1][w.count > 0], len(w.start))

    def lines(self) -> np.ndarray:
        """Where the words of each line begin, end last."""
        w = self.words
        line = np.concatenate([[0], np.cumsum(w.buf == 10)])[w.start] if len(w.buf) else np.zeros(0, np.int64)
        row = w.row()
        new = np.ones(len(w.start), bool)
        new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        return np.append(np.flatnonzero(new), len(w.start))


@dataclass
class Field:
    """Weights of the field: per language and bucket, of the lexicon, of transitions."""

    langs: list[str]
    grams: np.ndarray
    heads: np.ndarray
    tails: np.ndarray
    lexicon: np.ndarray
    trust: np.ndarray
    steps: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        out = np.empty((len(f.words.start), len(self.langs)), np.float32)
        if not len(out):
            return out
        bounds = np.column_stack([f.words.start, f.words.end]).ravel()
        if bounds[-1] == len(f.grams):
            bounds = bounds[:-1]
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.grams[k][f.grams], bounds)[::2]
            out[:, k] += self.heads[k][f.heads] + self.tails[k][f.tails] + self.trust[k] * self.lexicon[k][f.lexicon]
        return out


def _blocks(chains: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of chains cut into blocks of at most ``size`` words: where each block begins, its length, its chain and its number in
    the chain."""
    length = np.diff(chains)
    many = -(-length // size)
    chain = np.repeat(np.arange(len(length)), many)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(many) - many, many)
    begin = chains[:-1][chain] + number * size
    return begin, np.minimum(size, chains[1:][chain] - begin), chain, number


def _active(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks from the longest on, and how many of them have a word at each step."""
    order = np.argsort(-length, kind="stable")
    longest = int(length[order[0]]) if len(length) else 0
    return order, len(length) - np.searchsorted(length[order][::-1], np.arange(longest), side="right")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(1, keepdims=True), 1e-300)


def _transfers(e: np.ndarray, a: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What each block makes of a message that reaches its first word, up to a factor."""
    order, active = _active(length)
    first = begin[order]
    state = np.repeat(np.eye(a.shape[0])[None], len(begin), axis=0)
    for t, m in enumerate(active):
        state[:m] = (state[:m] @ a if t else state[:m]) * e[first[:m] + t][:, None, :]
        state[:m] /= np.maximum(state[:m].sum((1, 2), keepdims=True), 1e-300)
    out = np.empty_like(state)
    out[order] = state
    return out


def _messages(e: np.ndarray, a: np.ndarray, chains: np.ndarray, before: np.ndarray, after: np.ndarray, size: int, forth_only: bool = False):
    """Forward and backward messages of every word, ``before`` and ``after`` being those that reach each chain from outside;
    and those that leave it.

    What a block makes of a message is a matrix, found for all blocks at once; the messages then pass from block to block
    by these matrices, and within all blocks at once again. Nothing is cut: the result is that of one
    pass over each chain.
    """
    n, k = e.shape
    begin, length, chain, number = _blocks(chains, size)
    whole = np.empty((len(begin), k, k))
    several = np.flatnonzero(np.bincount(chain, minlength=len(chains) - 1)[chain] > (0 if forth_only else 1))
    whole[several] = _transfers(e, a, begin[several], length[several])
    order, active = _active(length)
    first = begin[order]
    prior, later = np.ones((len(begin), k)), np.ones((len(begin), k))
    prior[number == 0] = before
    last = np.append(number[1:] == 0, True) if len(number) else np.zeros(0, bool)
    later[last] = after
    steps = range(int(number.max()) if len(number) else 0)
    at = [np.flatnonzero(number == b) for b in range(len(steps) + 1)]
    for b in steps:
        x = at[b + 1]
        prior[x] = _unit((prior[x - 1][:, None, :] @ whole[x - 1])[:, 0] @ a)
    leave = np.zeros((len(chains) - 1, k))
    if forth_only:
        x = np.flatnonzero(last)
        leave[chain[x]] = _unit((prior[x][:, None, :] @ whole[x])[:, 0] @ a)
        return leave
    for b in reversed(steps):
        x = at[b + 1]
        later[x - 1] = _unit((whole[x] @ later[x][:, :, None])[:, :, 0] @ a.T)
    forward, backward = np.empty((n, k)), np.empty((n, k))
    state = prior[order]
    for t, m in enumerate(active):
        state = _unit((state[:m] @ a if t else state) * e[first[:m] + t])
        forward[first[:m] + t] = state
    end = first + length[order] - 1
    # Blocks that are as long as the step join with the message from behind them.
    backward[end] = later[order]
    for t in range(len(active) - 1, 0, -1):
        word = first[: active[t]] + t
        backward[word - 1] = _unit((e[word] * backward[word]) @ a.T)
    start = np.flatnonzero(number == 0)
    leave[chain[start]] = _unit((e[begin[start]] * backward[begin[start]]) @ a.T)
    return forward, backward, leave


def _weights(emissions: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.exp(emissions - emissions.max(1, keepdims=True)).astype(np.float64) if len(emissions) else emissions.astype(np.float64)
    return e, np.exp(steps - steps.max())


def marginals(emissions: np.ndarray, chains: np.ndarray, steps: np.ndarray, pairs: bool = False, size: int = BLOCK):
    """Posterior of each label at each word by forward-backward over the chains, and the expected transitions if asked for."""
    e, a = _weights(emissions, steps)
    none = np.ones((len(chains) - 1, e.shape[1]))
    forward, backward, _ = _messages(e, a, chains, none, none, size)
    p = _unit(forward * backward)
    if not pairs:
        return p
    inner = np.ones(len(e), bool)
    inner[chains[:-1]] = False
    word = np.flatnonzero(inner)
    left, right = forward[word - 1], e[word] * backward[word]
    weight = 1 / np.maximum((left * (right @ a.T)).sum(1, keepdims=True), 1e-300)
    return p, (left * weight).T @ right * a


def _gather(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the runs one after the other, and the run of each."""
    n = ends - starts
    run = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[run], run


def train_field(texts: list[str], langs: list[str], labels: list[str], lexicon: np.ndarray, epochs: int = EPOCHS) -> Field:
    """Fit the field to labelled texts by adaptive gradient steps over chains of two shuffled lines each, so that changes of
    language within a chain are seen too."""
    k = len(langs)
    f = Features(pa.array(texts, pa.string()))
    truth = np.array([langs.index(x) for x in labels])[f.words.row()]
    field = Field(langs, *(np.zeros((k, BUCKETS), np.float32) for _ in range(3)), lexicon, np.full(k, 0.3), np.eye(k))
    rng = np.random.Generator(np.random.PCG64(99))
    starts = f.lines()
    lines = len(starts) - 1
    rate, seen = 0.3, {}

    def step(name: str, g: np.ndarray):
        s = seen[name] = seen.get(name, 1e-4) + g * g
        w = getattr(field, name)
        w += (rate * (g - 1e-4 * w) / np.sqrt(s)).astype(w.dtype)

    for _ in range(epochs):
        order = rng.permutation(lines)
        for part in np.array_split(order, max(1, len(truth) // 8000)):
            word, run = _gather(starts[part], starts[part + 1])
            if not len(word):
                continue
            new = np.ones(len(word), bool)
            new[1:] = run[1:] // 2 != run[:-1] // 2
            chains = np.append(np.flatnonzero(new), len(word))
            byte, owner = _gather(f.words.start[word], f.words.end[word])
            grams = f.grams[byte]
            begin = np.searchsorted(owner, np.arange(len(word)))
            e = np.empty((len(word), k))
            lex = lexicon[:, f.lexicon[word]]
            for c in range(k):
                e[:, c] = np.add.reduceat(field.grams[c][grams], begin) + field.heads[c][f.heads[word]] + field.tails[c][f.tails[word]] + field.trust[c] * lex[c]
            p, expected = marginals(e, chains, field.steps, pairs=True)
            y = truth[word]
            d = -p
            d[np.arange(len(y)), y] += 1
            d /= len(word) / 1000
            observed = np.zeros((k, k))
            np.add.at(observed, (y[:-1][~new[1:]], y[1:][~new[1:]]), 1)
            step("grams", np.array([np.bincount(grams, d[owner, c], BUCKETS) for c in range(k)]))
            step("heads", np.array([np.bincount(f.heads[word], d[:, c], BUCKETS) for c in range(k)]))
            step("tails", np.array([np.bincount(f.tails[word], d[:, c], BUCKETS) for c in range(k)]))
            step("trust", (d * lex.T).sum(0))
            step("steps", (observed - expected) / (len(word) / 1000) - 0.05 * field.steps)
    return field


def lexicon_counts(docs: DataFrame, langs: list[str]) -> np.ndarray:
    """Centred log-frequencies per language and bucket of hashed words, over all ``docs`` (text, lang)."""
    place = {x: k for k, x in enumerate(langs)}

    @tidy
    def run(batches):
        held = np.zeros((len(langs), LEXICON), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(batch.column(0))
                lang = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
                cell = np.repeat(lang, w.count) * LEXICON + (w.hashes() & U(LEXICON - 1)).astype(np.int64)
                held += np.bincount(cell, minlength=held.size).reshape(held.shape)
        for k in np.flatnonzero(held.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([held[k].tobytes()], pa.binary())], names=["k", "counts"])

    def add(key, rows):  # one row a task and language
        total = np.sum([np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts")], axis=0)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((len(langs), LEXICON))
    parts = docs.select("text", "lang").mapInArrow(run, "k int, counts binary")
    for k, b in parts.groupBy("k").applyInArrow(add, "k int, counts binary").collect():  # one row a language
        counts[k] = np.frombuffer(b, np.int64)
    share = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * LEXICON))
    return (share - share.mean(0)).astype(np.float32) if len(langs) else counts.astype(np.float32)


def learn(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Field | None:
    """The field from documents (doc_id, text, lang) with a language; None without any.

    Counts of languages and of words cover all of them; the weights are fitted on about ``rows`` documents
    a language of up to ``chars`` characters, chosen by a hash of the id.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    langs = sorted(counts)
    chance = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows / counts[k])))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(5)), F.lit(1_000_003)) / 1_000_003
    picked = known.where((F.length("text") <= chars) & (draw < chance[F.col("lang")])).withColumn("draw", draw)
    picked = picked.orderBy("draw", "doc_id", "lang", "text").limit(2 * rows * len(langs))
    got = sorted(picked.select("doc_id", "text", "lang").collect(), key=lambda r: (str(r[0]), r[2], r[1]))
    return train_field([r[1] for r in got], langs, [r[2] for r in got], lexicon_counts(known, langs))


def _parts(raw: bytes, most: int) -> list[bytes]:
    """A text in parts of about ``most`` bytes that end at white space, so that no word is cut."""
    out, at = [], 0
    while at < len(raw):
        end = at + most
        if end < len(raw):
            found = _SPACE.search(raw, end)
            end = found.start() if found else len(raw)
        out.append(raw[at:end])
        at = end
    return out


def _sums(raw: bytes, field: Field, most: int) -> np.ndarray:
    """Sums of the posteriors of a long text's words that have a letter, as one chain.

    A pass over the parts keeps the message that enters each of them; the pass back makes each part's features again.
    """
    k = len(field.langs)
    parts = _parts(raw, most)
    none = np.ones((1, k))

    def read(part: bytes):
        f = Features(pa.array([part], pa.binary()))
        return f, *_weights(field.emissions(f), field.steps)

    entering = [none]
    for part in parts[:-1]:
        f, e, a = read(part)
        entering.append(_messages(e, a, f.chains, entering[-1], none, BLOCK, forth_only=True) if len(e) else entering[-1])
    total, after = np.zeros(k), none
    for part, before in zip(reversed(parts), reversed(entering), strict=True):
        f, e, a = read(part)
        if len(e):
            forward, backward, after = _messages(e, a, f.chains, before, after, BLOCK)
            total += _unit(forward * backward)[f.lettered].sum(0)
    return total


def label_texts(texts: pa.Array, field: Field | None, most: int = PART) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text, one chain each: the language with the largest mean posterior over the words
    that have a letter, and that mean; ``und`` and 0 for null texts, texts without a letter, or without a field. Equal
    sums go to the language first in order.
    """
    n = len(texts)
    lang, score = [UNKNOWN] * n, np.zeros(n)
    if field is None or not n:
        return lang, score
    if n == 1 and texts[0].is_valid and len(raw := texts[0].as_py().encode("utf-8")) > most:
        total, letters = _sums(raw, field, most)[None], [False]
    else:
        f = Features(texts)
        p = marginals(field.emissions(f), f.chains, field.steps)
        c = np.zeros((len(p) + 1, p.shape[1]))
        np.cumsum(p * f.lettered[:, None], axis=0, out=c[1:])
        total = c[f.words.first[1:]] - c[f.words.first[:-1]]
        plain = np.concatenate([[0], np.cumsum(_LETTER[f.words.buf] & (f.words.buf < 128))])
        letters = plain[f.words.off[1:]] > plain[f.words.off[:-1]]
    count = total.sum(1)
    best = total.argmax(1)
    for r in np.flatnonzero(count > 0.5).tolist():
        if letters[r] or any(map(str.isalpha, texts[r].as_py())):
            lang[r], score[r] = field.langs[best[r]], min(1.0, total[r, best[r]] / count[r])
    return lang, score


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, lang_pred and score of each whole text; see ``label_texts``. Repeated rows get equal results, an empty table
    gives no rows; other columns are not read."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                lang, score = label_texts(batch.column(1), field)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def with_language(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with lang_pred and lang_score (in place of columns of these names) beside its own columns; see
    ``label_texts``. Null and empty texts are ``und`` with score 0; an empty table stays empty."""

    @F.arrow_udf("lang string, score double")
    def label(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for batch in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            lang, score = label_texts(batch.column(0), field)
            langs += lang
            scores.append(score)
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["lang", "score"])

    # Said to be nondeterministic, so that a later filter on the result does not have texts labelled twice.
    out = docs.withColumn("language_", label.asNondeterministic()("text"))
    return out.withColumn("lang_pred", F.col("language_.lang")).withColumn("lang_score", F.col("language_.score")).drop("language_")


def held_out_rule(n: int = 5):
    """Whether crc32 of the id's text leaves no remainder by ``n``; null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == 0, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score; held-out documents teach nothing.

    Null and letterless texts are ``und`` with score 0; null languages teach nothing; repeated rows get equal results;
    an empty table gives no rows; other columns are not read.
    """
    field = learn(docs.select("doc_id", "text", "lang").where(~held_out_rule()))
    return predict(docs, field).withColumn("held_out", held_out_rule()).select("doc_id", "held_out", "lang_pred", "score")


def tag_words(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with words (in place of a column of that name): an array of (word, lang, score) over the whole text, for
    code-switched text; empty for null texts and texts without words."""

    @F.pandas_udf("array<struct<word:string,lang:string,score:double>>")
    def tags(texts):
        f = Features(pa.array(texts.fillna(""), pa.string()))
        p = marginals(field.emissions(f), f.chains, field.steps)
        w = f.words
        raw = w.buf.tobytes()
        one = [{"word": raw[a:b].decode("utf-8", "replace"), "lang": field.langs[k], "score": float(x)} for a, b, k, x in zip(w.start, w.end, p.argmax(1), p.max(1), strict=True)]
        return texts.__class__([one[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)], index=texts.index)

    return docs.withColumn("words", tags("text"))
