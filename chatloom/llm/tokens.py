"""Token ids of whole texts by a public byte-level BPE tokenizer, for use inside tasks.

``encode`` gives exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``. The
tokenizer's splitting rule never joins text across a single blank between two visible
characters, so a text's ids are those of its blank-separated pieces one after the other. Pieces
recur, and their ids are kept in arrays; only pieces not met before go through the tokenizer.
"""

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "byte_bpe_50k.json"
#: Pieces whose ids are kept in a worker; beyond that, the half met last is forgotten.
KEPT_PIECES = 1_500_000
#: Missing pieces that are encoded as one text.
WORDS_A_CALL = 64
#: Bytes of text that are encoded together.
BYTES_AT_ONCE = 4_000_000
#: Pieces whose ids are copied together.
_PIECES_AT_ONCE = 1 << 18

_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
_BLANK = "\u0120"  # how the vocabulary writes a blank
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _texts(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _flags(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False)


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def _stretches(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes`` ids from each of ``starts`` on, one stretch after the other."""
    out = np.empty(int(sizes.sum()), ids.dtype)
    done = 0
    for i in range(0, len(starts), _PIECES_AT_ONCE):
        some = sizes[i:i + _PIECES_AT_ONCE]
        ends = np.cumsum(some)
        n = int(ends[-1])
        at = np.repeat(starts[i:i + _PIECES_AT_ONCE] - (ends - some), some)
        at += np.arange(n)
        np.take(ids, at, out=out[done:done + n])
        done += n
    return out


class _Pieces:
    """Ids of distinct pieces, found by hash and compared letter by letter."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.ids = np.zeros(0, "<u4")
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sure = np.zeros(0, bool)  # whether the text is split before and behind the piece
        self._hash, self._number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # by hash

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 where it is not known."""
        out = np.full(len(words), -1, np.int64)
        if len(words) and len(self):
            found = _hashes(words)
            order = np.argsort(found)
            at = np.minimum(np.searchsorted(self._hash, found[order]), len(self) - 1)
            hit = self._hash[at] == found[order]
            asked, number = order[hit], self._number[at[hit]]
            same = _flags(pc.equal(words.take(pa.array(asked)), self.words.take(pa.array(number))))
            out[asked[same]] = number[same]
        return out

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """Numbers of words that are not known yet."""
        number = len(self) + np.arange(len(words))
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.ids = np.concatenate((self.ids, ids))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.sure = np.concatenate((self.sure, sure))
        found = _hashes(words)
        order = np.argsort(found)
        at = np.searchsorted(self._hash, found[order])
        self._hash = np.insert(self._hash, at, found[order])
        self._number = np.insert(self._number, at, number[order])
        return number

    def keep(self, n: int) -> None:
        """Forgets all but the first ``n`` words."""
        stays = self._number < n
        self._hash, self._number = self._hash[stays], self._number[stays]
        self.words = pa.concat_arrays([self.words.slice(0, n), self.words.slice(0, 0)])
        self.ids = self.ids[:self.starts[n]].copy()
        self.starts, self.sizes, self.sure = self.starts[:n].copy(), self.sizes[:n].copy(), self.sure[:n].copy()


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, in bytes.

    Strings of special tokens count as ordinary text. A null text has the ids of an empty one.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        vocabulary = self._tokenizer.get_vocab()
        self._blank_first = np.zeros(max(vocabulary.values()) + 1, bool)
        self._blank_first[[i for token, i in vocabulary.items() if token.startswith(_BLANK)]] = True
        self._kept = kept
        self._after_blank = _Pieces()
        self._alone: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def _learn_alone(self, pieces) -> None:
        new = [p for p in dict.fromkeys(pieces) if p not in self._alone]
        self._alone.update(zip(new, (x.tobytes() for x in self._ids(new)), strict=True))

    def _ids_after_blank(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers; many words in one call, parted again at ids that hold their blanks."""
        joined = [" " + " ".join(words[i:i + WORDS_A_CALL]) for i in range(0, len(words), WORDS_A_CALL)]
        ids = np.concatenate([np.zeros(0, "<u4"), *self._ids(joined)])
        starts = np.flatnonzero(self._blank_first[ids])
        if len(starts) == len(words):
            return ids, np.diff(starts, append=len(ids))
        return self._ids_one_by_one(words)

    def _ids_one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._ids([" " + w for w in words])
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.array([len(x) for x in found], np.int64)

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers in ``_after_blank`` of distinct pieces; those not met before are encoded."""
        numbers = self._after_blank.find(pieces)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self._learn(pieces.take(pa.array(new)))
        return numbers

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        known, size = self._after_blank, pc.binary_length(pieces)
        stems = pc.ascii_rtrim(pieces, characters=_MARKS)
        # letters with marks behind them: the rule splits between
        marked = _flags(pc.and_(pc.utf8_is_alpha(stems), pc.less(pc.binary_length(stems), size)))
        trimmed = pc.binary_length(pc.utf8_trim_whitespace(pieces))
        whole = _flags(pc.and_(pc.equal(trimmed, size), pc.greater(size, 0))) & ~marked
        spaced = _flags(pc.match_substring(pieces, " ")) & whole
        odd, plain = ~whole & ~marked, whole & ~spaced
        numbers = np.empty(len(pieces), np.int64)

        # pieces without a blank inside, and stems that are not known
        words = pieces.filter(pa.array(plain))
        stems = stems.filter(pa.array(marked))
        coded = stems.dictionary_encode()
        of_stems = known.find(coded.dictionary)
        missing = coded.dictionary.filter(pa.array(of_stems < 0))
        words = pa.concat_arrays([words, missing.filter(pc.invert(pc.is_in(missing, value_set=words)))])
        ids, sizes = self._ids_after_blank(_texts(words))
        added = known.add(words, ids, sizes, np.ones(len(words), bool))
        numbers[plain] = added[:plain.sum()]
        of_stems[of_stems < 0] = added[pc.index_in(missing, value_set=words).to_numpy()]

        if len(stems):
            whole_pieces = zip(_texts(pieces.filter(pa.array(marked))), _texts(stems), strict=True)
            tails = pa.array([p[len(stem):] for p, stem in whole_pieces], pa.large_string()).dictionary_encode()
            self._learn_alone(_texts(tails.dictionary))
            of_tails = [np.frombuffer(self._alone[t], "<u4") for t in _texts(tails.dictionary)]
            tail_sizes = np.array([len(x) for x in of_tails], np.int64)
            tail_starts = len(known.ids) + np.cumsum(tail_sizes) - tail_sizes
            tail = tails.indices.to_numpy()
            stem = of_stems[coded.indices.to_numpy()]
            starts = np.stack((known.starts[stem], tail_starts[tail]), axis=1).reshape(-1)
            sizes = np.stack((known.sizes[stem], tail_sizes[tail]), axis=1)
            ids = _stretches(np.concatenate((known.ids, *of_tails)), starts, sizes.reshape(-1))
            numbers[marked] = known.add(pieces.filter(pa.array(marked)), ids, sizes.sum(axis=1), np.ones(len(stem), bool))
        if spaced.any():
            words = pieces.filter(pa.array(spaced))
            numbers[spaced] = known.add(words, *self._ids_one_by_one(_texts(words)), np.ones(len(words), bool))
        if odd.any():
            n = int(odd.sum())
            words = pieces.filter(pa.array(odd))
            numbers[odd] = known.add(words, np.zeros(0, "<u4"), np.zeros(n, np.int64), np.zeros(n, bool))
        return numbers

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(self._after_blank) > self._kept:  # frequent pieces are met early: those stay
            self._after_blank.keep(self._kept // 2)
        if len(self._alone) > self._kept:
            for piece in list(self._alone)[self._kept // 2:]:
                del self._alone[piece]
        known = self._after_blank
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        first, count = bounds[:-1], np.diff(bounds)

        after = np.ones(len(codes), bool)  # all but the first piece of each text
        after[first] = False
        asked = np.zeros(len(distinct), bool)
        asked[codes[after]] = True
        numbers = np.full(len(distinct), -1, np.int64)
        numbers[asked] = self._numbers(distinct.filter(pa.array(asked)))
        firsts = _texts(distinct.take(pa.array(codes[first])))
        number = numbers[codes[after]]

        spaced = np.zeros(len(codes), bool)
        spaced[after] = ~known.sure[number]
        spaced = np.logical_or.reduceat(spaced, first)
        spaced |= np.array([n > 1 and (not f or f[-1].isspace()) for f, n in zip(firsts, count.tolist(), strict=True)])
        ids = _stretches(known.ids, known.starts[number], known.sizes[number]).tobytes()
        sizes = np.zeros(len(codes) + 1, np.int64)
        sizes[1:][after] = known.sizes[number]
        ends = 4 * np.cumsum(sizes)[bounds]

        self._learn_alone(f for f, s in zip(firsts, spaced.tolist(), strict=True) if not s)
        rest = iter(self._encode_spaced(_texts(texts.filter(pa.array(spaced)))))
        return [
            next(rest) if s else self._alone[f] + ids[a:b]
            for f, s, a, b in zip(firsts, spaced.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        ]

    def _encode_spaced(self, texts: list[str]) -> list[bytes]:
        """Texts with runs of white space: parted only where a boundary is sure."""
        split = []
        for text in texts:
            pieces = _BOUNDARY.split(text)
            blank = [len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace() for p in pieces]
            split.append((pieces, blank))
        after = list(dict.fromkeys(p[1:] for pieces, blank in split for p, b in zip(pieces, blank, strict=True) if b))
        numbers, known = self._numbers(pa.array(after, pa.large_string())), self._after_blank
        stretches = zip(known.starts[numbers].tolist(), known.sizes[numbers].tolist(), strict=True)
        ids = dict(zip(after, (known.ids[a:a + n].tobytes() for a, n in stretches), strict=True))
        self._learn_alone(p for pieces, blank in split for p, b in zip(pieces, blank, strict=True) if not b)
        return [
            b"".join(ids[p[1:]] if b else self._alone[p] for p, b in zip(pieces, blank, strict=True))
            for pieces, blank in split
        ]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def text_slices(batch, column: str = "text", most: int = BYTES_AT_ONCE):
    """Rows of an Arrow batch, about ``most`` bytes of text at a time and a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encoded_batches(rows, path: str, end_id: int):
    """(keys, ids) of each row of Arrow batches with columns ``doc_id`` and ``text``.

    ``ids`` are little-endian unsigned 32-bit integers in bytes, ``end_id`` included.
    """
    end = np.array([end_id], "<u4").tobytes()
    encode = encoder(path).encode
    for batch in rows:
        for some in text_slices(batch):
            found = encode(some.column("text"))
            yield some.column("doc_id").to_pylist(), [ids + end for ids in found]
