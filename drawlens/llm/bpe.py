"""Byte-level BPE, encoded by replaying the merges over a corpus of words."""

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NONE = np.int64(1 << 40)  # above every rank


class Vocabulary:
    """A rank file: token bytes by id, and the pairs of tokens that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        top = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for token, r in ranks.items():
            self.bytes_of[r] = token
        self.text_of = [str(i) for i in range(top)]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.merged = found[:, 0].copy(), found[:, 1].copy()
        # A token is calm if no pair that it takes part in has a lower rank: merging all its places at once is then the same as one by one.
        self.calm = np.ones(top, bool)
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            self.calm[side[self.merged < side]] = False

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the pair doesn't merge."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)


def replay(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and where each word's begin (one more for the end).

    All merges are applied to all words together, lowest rank first. An index from rank to the places of its pairs says where a merge
    applies; only the neighbours of a merged place get new pairs. A merge whose result pairs up at a lower rank puts that rank back into the
    queue, so that each word sees its merges in the order of always taking its lowest, leftmost pair. A word that is a token stays whole.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    sym = vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    word = np.repeat(np.arange(len(words)), sizes)
    nxt, prv, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
    full = sizes > 0
    nxt[ends[full] - 1] = -1
    prv[(ends - sizes)[full]] = -1
    whole = np.fromiter((vocab.ranks.get(w, -1) for w in words), np.int64, len(words))
    first = (ends - sizes)[(whole >= 0) & full]
    done = (whole >= 0)[word]
    alive[done] = False
    alive[first], sym[first] = True, whole[(whole >= 0) & full]
    cur = np.full(n, NONE)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Looks up the pairs that begin at these places, and files them under their ranks."""
        r = np.full(len(at), NONE)
        has = nxt[at] >= 0
        r[has] = vocab.rank(sym[at[has]], sym[nxt[at[has]]])
        cur[at] = r
        at, r = at[r < NONE], r[r < NONE]
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(at)]
        for k, rank in enumerate(r[np.r_[0, cuts]].tolist()):
            if rank not in index:
                index[rank] = []
                heapq.heappush(queue, rank)
            index[rank].append(at[bounds[k] : bounds[k + 1]])

    enter(np.flatnonzero((nxt >= 0) & ~done))
    while queue:
        rank = heapq.heappop(queue)
        held = index.pop(rank)
        at = np.unique(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
        at = at[cur[at] == rank]
        if not len(at):
            continue
        # Of places that overlap (the same token again and again), every second one from the left.
        follows = np.r_[False, nxt[at[:-1]] == at[1:]]
        i = np.arange(len(at))
        taken = (i - np.maximum.accumulate(np.where(follows, 0, i))) % 2 == 0 if follows.any() else np.ones(len(at), bool)
        if not vocab.calm[rank]:
            # Up to the first place of each word whose merge pairs up at a lower rank; the others come after that pair.
            taken[taken] = _before_lower(vocab, rank, at[taken], sym, nxt, prv, word)
            if not taken.all():
                index[rank] = [at[~taken]]
                heapq.heappush(queue, rank)
        at = at[taken]
        gone = nxt[at]
        after = nxt[gone]
        sym[at], nxt[at], alive[gone], cur[gone] = rank, after, False, NONE
        has = after >= 0
        prv[after[has]] = at[has]
        before = prv[at]
        enter(np.unique(np.concatenate([at, before[before >= 0]])))
    return sym[alive], np.r_[0, np.cumsum(np.bincount(word[alive], minlength=len(words)))]


def _before_lower(vocab: Vocabulary, rank: int, at: np.ndarray, sym: np.ndarray, nxt: np.ndarray, prv: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which of the places `at` (of pairs of this rank, in order, none of which overlap) can be merged in one turn: in each word those up to the first whose merge gives a pair of a lower rank, that one included."""
    after, before = nxt[nxt[at]], prv[at]
    joined = np.r_[False, after[:-1] == at[1:]]  # the place before ends here, so it is merged by then
    lower = np.zeros(len(at), bool)
    has = before >= 0
    lower[has] = vocab.rank(np.where(joined, rank, sym[before])[has], np.full(int(has.sum()), rank)) < rank
    has = after >= 0
    lower[has] |= vocab.rank(np.full(int(has.sum()), rank), sym[after[has]]) < rank
    if not lower.any():
        return np.ones(len(at), bool)
    earlier = np.cumsum(lower) - lower
    starts = np.r_[True, word[at[1:]] != word[at[:-1]]]
    return earlier == earlier[starts][np.cumsum(starts) - 1]


class Lexicon:
    """The words that a task has met, each with its ids: merges are replayed over what is new of each next part of the corpus, all new words together."""

    MOST, MOST_BYTES = 1 << 19, 64 << 20  # words that are kept, and their bytes; beyond, the lexicon begins anew, which changes no ids

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.starts, self.bytes = np.zeros(0, np.int64), np.zeros(1, np.int64), 0

    def places(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        """The numbers of the words of each text; their ids are known from then on. Texts are taken one by one, so only what is new of their words is held."""
        if len(self.number) > self.MOST or self.bytes > self.MOST_BYTES:
            self.clear()
        before = len(self.number)
        used = [np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)) for words in texts]
        new = [w.encode("utf-8", "surrogatepass") for w in islice(self.number, before, None)]
        self.bytes += sum(map(len, new))
        ids, starts = replay(self.vocab, new)
        self.starts = np.concatenate([self.starts, starts[1:] + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        return used


def encode(lexicon: Lexicon, pattern, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and where each text's begin."""
    used = lexicon.places(map(pattern.findall, texts))
    ids, starts = lexicon.ids, lexicon.starts
    sizes = starts[1:] - starts[:-1]
    at = np.concatenate(used) if used else np.zeros(0, np.int32)
    lengths = sizes[at]
    ends = np.cumsum(lengths)
    picked = np.repeat(starts[:-1][at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    of_text = np.add.reduceat(np.r_[lengths, 0], np.minimum(np.cumsum([0, *map(len, used)])[:-1], len(lengths))) if texts else np.zeros(0, np.int64)
    of_text = np.where([len(u) > 0 for u in used], of_text, 0)
    return ids[picked], np.r_[0, np.cumsum(of_text)].astype(np.int64)


def decode(vocab: Vocabulary, ids: list[int]) -> bytes:
    """The bytes of the ids; an id that no token has, in the range of ids, gives none, and one beyond it is an IndexError."""
    return b"".join(map(vocab.bytes_of.__getitem__, ids))


def tokenised(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True, chunk: int = 4 << 20) -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256, decoded_sha256 and, if asked for, `ids`.

    Texts are encoded as the rank file at `path` (read by the driver; its size is that of the vocabulary) and `pattern` say, without special tokens. Each task replays the merges over the
    distinct words of its part of the corpus, `chunk` bytes of text after the other, a word once (Lexicon): tasks need nothing of each other, nothing is shuffled,
    and memory is bounded. ids_sha256 is of the decimal ids joined by commas; decoded_sha256 of the bytes that the ids give.
    A null text counts as empty (no tokens); an empty table gives an empty result; columns of docs that bear a name of the result are replaced.
    """
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    made += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    kept = [c for c in docs.columns if c != text and c not in {f.name for f in made}]
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    schema = T.StructType([docs.schema[c] for c in kept] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        v, find = vocab.value, regex.compile(pattern)
        lexicon = Lexicon(v)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = np.cumsum(np.diff(_offsets(texts)))
            at = 0
            while at < batch.num_rows:
                past = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, past + chunk)))
                some = [x or "" for x in texts.slice(at, end - at).to_pylist()]
                flat, starts = encode(lexicon, find, some)
                digests, decoded, lists = [], [], []
                for i in range(len(some)):
                    own = flat[starts[i] : starts[i + 1]].tolist()
                    digests.append(hashlib.sha256(",".join(map(v.text_of.__getitem__, own)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(decode(v, own)).hexdigest())
                    if ids:
                        lists.append(own)
                columns = [batch.column(i).slice(at, end - at) for i in range(len(kept))]
                columns += [pa.array(np.diff(starts)), pa.array(digests), pa.array(decoded)] + [pa.array(lists, pa.list_(pa.int32()))] * ids
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at = end

    return docs.select(*kept, text).mapInArrow(run, schema)


def _offsets(texts: pa.Array) -> np.ndarray:
    """The byte offsets of a string array."""
    wide = pa.types.is_large_string(texts.type)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
