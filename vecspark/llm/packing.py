"""Hierarchical packing of tokenised documents into windows of several lengths.

Each task packs the documents of its own partition in one pass, without a shuffle: documents are
tokenised, whole windows are cut off long ones, what remains is routed to the smallest tier that
holds it, each tier is packed, gaps of longer windows are filled from shorter tiers (the last filler
is cut to fit), and what is left at the end is cut at powers of two.  Only the last piece below the
smallest tier is ever padded, once per partition.
"""

from __future__ import annotations

import gc
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Window lengths, each a power of two; the last is the longest.
TIERS = (512, 1024, 2048, 4096)
#: Marks that may stand behind a plain word.
MARKS = '.,;:!?#$%&*()[]"'
#: Plain words in letters of Western languages.
PLAIN = rf"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[{re.escape(MARKS)}]*)$"
#: The id that ends each document.
END_ID = 2
#: Tokens that are routed and packed together; bounds a task's memory.
BATCH_TOKENS = 1 << 21
#: Tokens of a step group.
STEP_TOKENS = 1 << 19
#: Words (of each of two kinds) whose ids a Python worker remembers, the longest word that is, and bytes of text looked up together.
CACHE_WORDS, CACHE_LENGTH, TOGETHER = 400_000, 64, 1 << 21

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent:
    """Ids of words as bytes, remembered for the words that were asked for last."""

    def __init__(self, find: Callable[[list[str]], list[bytes]]):
        self.find = find
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.now) + len(self.before)

    def _put(self, out: list[bytes | None], words: list[str], get: Callable[[list[str]], list[bytes | None]]) -> None:
        """Fills the gaps of ``out`` with what ``get`` finds, which is remembered."""
        at = [i for i, x in enumerate(out) if x is None]
        if at:
            asked = [words[i] for i in at]
            for i, w, x in zip(at, asked, get(asked)):
                out[i] = x
                if x is not None and len(w) <= CACHE_LENGTH:
                    self.now[w] = x

    def __call__(self, words: list[str]) -> list[bytes]:
        """For distinct words."""
        out = list(map(self.now.get, words))
        self._put(out, words, lambda asked: list(map(self.before.get, asked)))
        self._put(out, words, self.find)
        if len(self.now) > CACHE_WORDS // 2:
            self.before, self.now = self.now, {}
        return out


class WordTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers.

    The vocabulary's model never joins across white space nor a letter with a mark, so the ids of a text
    are those of its words in turn.  Texts are split, and their ids put together, by Arrow; only distinct
    words are met here.  New plain words (letters, then marks) are encoded many at a time, as each ends
    with a token that only ends words.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(vocabulary)
        # for letters in lower case the steps before the model come to this
        self.bare = Tokenizer(self.model.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.stems = Recent(self._find_stems)
        self.known = Recent(self._find)  # of marks, and of words that are not plain or not Western

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _find_stems(self, stems: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(stems), 10_000):
            some = stems[k : k + 10_000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                blob, at = ids.tobytes(), (cuts * 4).tolist()
                out += [blob[i:j] for i, j in zip([0, *at], at)]
            else:
                out += self._encode(some)  # not met so far
        return out

    def _find(self, words: list[str]) -> list[bytes]:
        plain = {w: p for w in words if (p := self.plain(w))}
        stems, tails = ({x: None for x in part} for part in zip(*plain.values())) if plain else ({}, {})
        rest = [w for w in words if w not in plain]
        ids = dict(zip(rest, self._encode(rest)))
        stems = dict(zip(stems, self.stems(list(stems))))
        tails = dict(zip(tails, self._encode(list(tails))))
        return [stems[plain[w][0]] + tails[plain[w][1]] if w in plain else ids[w] for w in words]

    @staticmethod
    def plain(word: str) -> tuple[str, str] | None:
        """(letters in lower case, marks behind them), if the word is just that in any reading."""
        stem = word.rstrip(MARKS)
        if not stem.isalpha() or "\u03a3" in stem:  # a final capital sigma has two lower cases
            return None
        low = stem.lower()
        if not low.isascii() and not (low.isalpha() and unicodedata.is_normalized("NFC", stem) and unicodedata.is_normalized("NFC", low)):
            return None
        return low, word[len(stem) :]

    @staticmethod
    def _of(distinct: pa.DictionaryArray, recent: Recent) -> pa.Array:
        """The ids of each word, none of which holds a blank."""
        words = distinct.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        return pa.array(recent(joined.split(" ") if len(words) else []), pa.large_binary()).take(distinct.indices)

    def batch(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, then the end id."""
        # other white space and the vocabulary's added tokens stay within words, which the model splits
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        words = split.values.dictionary_encode()
        parts = pc.extract_regex(words.dictionary, PLAIN)
        fits = parts.is_valid().to_numpy(zero_copy_only=False)
        parts = parts.drop_null()
        stems = self._of(pc.utf8_lower(parts.field("stem")).dictionary_encode(), self.stems)
        tails = self._of(parts.field("tail").dictionary_encode(), self.known)
        odd = self.known(words.dictionary.filter(pa.array(~fits)).to_pylist())
        ids = pa.concat_arrays([pc.binary_join_element_wise(stems, tails, pa.scalar(b"", pa.large_binary())), pa.array([*odd, END_ID.to_bytes(4, "little")], pa.large_binary())])
        place = np.empty(len(fits), np.int64)
        place[fits], place[~fits] = np.arange(len(parts)), np.arange(len(parts), len(fits))
        ends = split.offsets.to_numpy()  # of the words of each text; the end id is put behind them
        whole = ids.take(pa.array(np.insert(place[words.indices.to_numpy()], ends[1:], len(fits))))
        at = np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1][ends + np.arange(len(ends))] // 4
        flat = np.frombuffer(whole.buffers()[2], "<u4")
        return [flat[i:j] for i, j in zip(at, at[1:])]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(vocabulary: str) -> WordTokenizer:
    """One for each Python worker, so that tasks find the words of tasks before."""
    if vocabulary not in _tokenizers:
        _tokenizers[vocabulary] = WordTokenizer(vocabulary)
    return _tokenizers[vocabulary]


class Piece:
    """Tokens [start, start + length) of a document."""

    __slots__ = ("doc", "start", "length")

    def __init__(self, doc: int, start: int, length: int):
        self.doc, self.start, self.length = doc, start, length

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, n), Piece(self.doc, self.start + n, self.length - n)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, final: bool = True) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Packs documents of the given token counts; returns (tier, pieces) windows and what waits for more.

    Every window but those of the last partial length is exactly full.  With ``final`` nothing waits:
    the rest is cut at powers of two, and below the smallest tier one short window is left.
    """
    top = tiers[-1]
    full: list[tuple[int, list[Piece]]] = []
    shelf: dict[int, list[Piece]] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= top:
            full.append((top, [Piece(doc, at, top)]))
            at += top
        if n > at:
            shelf[tiers[bisect_left(tiers, n - at)]].append(Piece(doc, at, n - at))
    queues = {t: deque(sorted(p, key=lambda x: -x.length)) for t, p in shelf.items()}
    for k in range(len(tiers) - 1, -1, -1):
        t = tiers[k]
        fillers = [queues[s] for s in reversed(tiers[: k + 1])]
        while queues[t]:
            window, room = [queues[t].popleft()], t
            room -= window[0].length
            for q in fillers:  # whole documents first, the longest that fit
                while q and q[-1].length <= room:
                    p = q.popleft() if q[0].length <= room else q.pop()
                    window.append(p)
                    room -= p.length
            while room:  # then one is cut to fill what is left
                q = next((q for q in reversed(fillers) if q), None)
                if q is None:
                    break
                p = q.popleft()
                if p.length > room:
                    p, tail = p.cut(room)
                    queues[tiers[bisect_left(tiers, tail.length)]].append(tail)
                window.append(p)
                room -= p.length
            if room:  # too little is left for another window
                queues[t].extend(window)
                break
            full.append((t, window))
    rest = [p for t in tiers for p in queues[t]]
    if not final:
        return full, rest
    left = sum(p.length for p in rest)
    rest = deque(rest)
    while left:
        size = min(top, 1 << (left.bit_length() - 1))
        if size < tiers[0]:
            size = left
        window, room = [], size
        while room:
            p = rest.popleft()
            if p.length > room:
                p, tail = p.cut(room)
                rest.appendleft(tail)
            window.append(p)
            room -= p.length
        full.append((size, window))
        left -= size
    return full, []


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each window: windows are dealt longest first, back and forth, so groups get like shares of every tier."""
    groups = max(1, -(-sum(sizes) // step_tokens))
    out = [0] * len(sizes)
    for i, w in enumerate(sorted(range(len(sizes)), key=lambda w: (-sizes[w], w))):
        turn, at = divmod(i, groups)
        out[w] = at if turn % 2 == 0 else groups - 1 - at
    return out


def _packer(vocabulary: str, id_col: str, text_col: str, tiers: tuple[int, ...], batch_tokens: int, step_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary)
        base = TaskContext.get().partitionId() << 36
        sequences = groups = 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        starts: list[int] = []  # of what of the document waits here
        totals: list[int] = []
        held = 0

        def flush(final: bool):
            nonlocal sequences, groups, ids, docs, starts, totals, held
            windows, rest = pack([len(x) for x in ids], tiers, final)
            steps = step_groups([n for n, _ in windows], step_tokens)
            cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")}
            for (size, window), step in zip(windows, steps):
                at = 0
                for p in window:
                    row = (docs[p.doc], starts[p.doc] + p.start, p.length, zlib.crc32(ids[p.doc][p.start : p.start + p.length].tobytes()), totals[p.doc], base + sequences, at, size, base + groups + step)
                    for c, v in zip(cols.values(), row):
                        c.append(v)
                    at += p.length
                sequences += 1
            groups += max(steps, default=-1) + 1
            keep = [(ids[p.doc][p.start : p.start + p.length].copy(), docs[p.doc], starts[p.doc] + p.start, totals[p.doc]) for p in rest]
            ids, docs, starts, totals = ([x[i] for x in keep] for i in range(4))
            held = sum(map(len, ids))
            if cols["doc_id"]:
                types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols.values(), types)], names=list(cols))

        gc.disable()  # words are many small objects and none of them refer in a circle
        try:
            for batch in batches:
                texts = batch.column(1).fill_null("")
                sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
                cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // TOGETHER, prepend=-1, append=-1)).tolist()
                for k, end in zip(cuts, cuts[1:]):
                    for doc, x in zip(batch.column(0)[k:end].to_pylist(), words.batch(texts[k:end].cast(pa.string()))):
                        ids.append(x)
                        docs.append(doc)
                        starts.append(0)
                        totals.append(len(x))
                        held += len(x)
                        if held >= batch_tokens:
                            yield from flush(False)
            yield from flush(True)
        finally:
            gc.enable()

    return run


def pack_documents(
    docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    tiers: tuple[int, ...] = TIERS, batch_tokens: int = BATCH_TOKENS, step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    ``vocabulary`` is the path of a tokenizer file that every executor has (by default the installed
    public one).  A null text is an empty text and gives the end id alone; a null id stays null; rows
    that repeat an id are packed as documents of their own; an empty table gives no pieces.  Only the
    two named columns are read.  Sequence ids are unique over partitions; a repeated task makes the
    same pieces again, as it reads the same rows in the same order.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(_packer(vocabulary or default_vocabulary(), "doc_id", "text", tiers, batch_tokens, step_tokens), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
