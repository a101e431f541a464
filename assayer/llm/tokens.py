"""Token ids by a ``tokenizers`` BPE file, whole Arrow columns at a time.

BPE splits at white space first, so a text's ids are those of its white-space chunks in order.
Each distinct chunk of a column is encoded by the library once and remembered (within a bound) by
the Python worker; a column is then one dictionary encoding and one gather.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that end a letter run and join no other character; "<" and ">" belong to special tokens, "'" to contractions.
TRAILING = ".,!*$%&#:;?()[]{}=/\"^~`"
#: Text bytes encoded at once, and distinct chunks remembered by a worker.
SLICE_BYTES, MEMO_LIMIT = 6 << 20, 200_000


class ChunkEncoder:
    """Encodes columns of texts; ``vocabulary_size`` bounds the ids."""

    def __init__(self, path: str, memo_limit: int = MEMO_LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary_size = self.tokenizer.get_vocab_size()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo_limit = memo_limit
        self.memo: dict[str, bytes] = {}

    def _letters(self, word: str) -> bool:
        """Whether the tokenizer sees letters alone, also after its normaliser, which parts some letters from their marks."""
        return word.isalpha() and (word.isascii() or self.tokenizer.normalizer is None or self.tokenizer.normalizer.normalize_str(word).isalpha())

    def _learn(self, words: list[str], into: dict[str, bytes]) -> None:
        """Put the ids of ``words`` in ``into``; pure letter runs go to the library many at a time."""
        letters, rest = [], []
        for word in words:
            (letters if self._letters(word) else rest).append(word)
        for at in range(0, len(letters), 4096):
            part = letters[at : at + 4096]
            (found,) = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) != len(part):  # a vocabulary without marks of word ends
                rest += part
                continue
            ids, ends = ids.tobytes(), [0, *(4 * cuts).tolist()]
            into.update(zip(part, (ids[a:b] for a, b in zip(ends, ends[1:]))))
        for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            into[word] = np.array(found.ids, dtype="<u4").tobytes()

    def _table(self, vocabulary: list[str]) -> list[bytes]:
        """Ids of each chunk.  Words that the full memory has no room for serve this slice alone: early words are the frequent ones."""
        get = self.memo.get
        table = list(map(get, vocabulary))
        open_at = [i for i, ids in enumerate(table) if ids is None]
        parts, need = [], set()
        for i in open_at:
            chunk = vocabulary[i]
            base = chunk.rstrip(TRAILING)
            if base.isascii() and base.isalpha():
                tail = chunk[len(base) :]
                base = base.lower()  # as the normaliser does; one entry for all spellings
            elif len(base) < len(chunk) and self._letters(base):  # else a mark joins the punctuation behind it
                tail = chunk[len(base) :]
            else:
                base, tail = chunk, ""
            parts.append((base, tail))
            if get(base) is None:
                need.add(base)
            if get(tail) is None:
                need.add(tail)
        learnt = {}
        self._learn(list(need), learnt)
        if len(self.memo) + len(learnt) <= self.memo_limit:
            self.memo.update(learnt)
            learnt = self.memo
        else:
            learnt = learnt | {w: self.memo[w] for pair in parts for w in pair if w not in learnt}
        for i, (base, tail) in zip(open_at, parts):
            table[i] = learnt[base] + learnt[tail]
        return table

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks = pc.ascii_split_whitespace(texts)
        ends = chunks.offsets.to_numpy().astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        table = pa.array(self._table(coded.dictionary.to_pylist()), pa.large_binary())
        taken = table.take(coded.indices)
        upto = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(taken) + 1] // 4
        data = taken.buffers()[2]
        ids = np.frombuffer(data, dtype="<u4")[: upto[-1]] if data is not None else np.zeros(0, "<u4")
        return ids, upto[ends - ends[0]]

    def encode(self, texts: pa.Array, end_id: int | None = None):
        """Yield ``(first row, ids, offsets)`` for slices of the column; nulls are empty texts.

        Row ``first + i`` has ``ids[offsets[i]:offsets[i + 1]]``, with ``end_id`` at its end if given.
        """
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
            ids, offsets = self._encode_slice(texts[at:to])
            if end_id is not None:
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
            yield at, ids, offsets
            at = to


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """This Python worker's encoder for a tokenizer file."""
    return ChunkEncoder(path)


def default_path() -> str:
    """The word BPE of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
