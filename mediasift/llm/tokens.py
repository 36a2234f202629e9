"""Token ids by the tokenizers library, with a cache of ids by chunk.

Both vocabularies split a text before they merge, and no piece of that split
holds white space after another character; no special name holds white space. So a text falls apart before its
white space into chunks that encode the same alone as in the text. A batch of texts
is cut in Arrow, its distinct chunks are looked up, the library encodes those
not known yet, and the ids are put together as arrays. The cache is bounded and lives as
long as the Python worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks a Python worker keeps; beyond that its cache starts anew. Bytes of text encoded together.
CACHED_CHUNKS, BYTES = 2_000_000, 16 << 20

# White space of Unicode but for the single blank and line feed.
_RARE = "\t\x0b\x0c\r" + "".join(map(chr, (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_CHUNK = re.compile(f"[ \n{_RARE}]*[^ \n{_RARE}]+|[ \n{_RARE}]+")
# Up to two blanks or line feeds before a word are pieces of their own, of longer runs and at a text's end they are one.
_UNUSUAL = f"[ \n]{{3}}|[ \n]{{2}}\\z|[{_RARE}\0]"
# Letters that no normalisation takes apart are one piece, apart from a mark behind them.
_PARTS = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
# The letter that stands for each byte in byte-level vocabularies: itself if it is printed, else the next free one from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``spaced``: white space belongs to the ids (byte-level vocabularies);
    otherwise the vocabulary drops it."""

    def __init__(self, path: str, spaced: bool, cached: int = CACHED_CHUNKS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.spaced, self.cached = self.tokenizer.model, spaced, cached
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._empty()

    def _empty(self) -> None:
        """Known chunks; chunk i has the ids flat[starts[i]:starts[i + 1]]."""
        self.known = pa.array([], pa.string())
        self.flat, self.starts = np.empty(0, self.dtype), np.zeros(1, np.int64)

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        if not self.spaced:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        odd = pc.match_substring_regex(texts, _UNUSUAL)
        usual = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(usual, "\0")
        if not pc.any(odd).as_py():
            return lists
        own = pa.array([_CHUNK.findall(x) for x in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
        places = np.empty(len(texts), np.int64)
        is_odd = odd.to_numpy(zero_copy_only=False)
        places[~is_odd], places[is_odd] = np.flatnonzero(~is_odd), len(texts) + np.arange(len(own))
        return pa.concat_arrays([lists, own]).take(pa.array(places))

    def _piece(self, blank: str, word: str) -> list[int]:
        """Ids of a word that is one piece of the split, by the vocabulary's merges alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.model.tokenize(("Ġ" if blank else "") + word)]

    def _learn(self, new: list[str]) -> None:
        """Adds chunks to the known ones. What is more than a word and a mark goes through the whole library."""
        ids: list[list[int]] = []
        marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ("", ".", ",")}
        words: dict[tuple[str, str], list[int]] = {}
        other = []
        for i, chunk in enumerate(new):
            if (form := _PARTS.fullmatch(chunk)) is None:
                other.append(i)
                ids.append([])
                continue
            blank, word, mark = form.groups()
            if not self.spaced:
                blank, word = "", word.lower()
            found = words.get((blank, word))
            if found is None:
                found = words[blank, word] = self._piece(blank, word)
            ids.append(found + marks[mark])
        for low in range(0, len(other), 100):
            places = other[low : low + 100]
            found = self.tokenizer.encode([new[i] for i in places], is_pretokenized=True, add_special_tokens=False)
            for id_, of in zip(found.ids, found.word_ids, strict=True):
                ids[places[of]].append(id_)
        sizes = np.cumsum([len(x) for x in ids])
        self.known = pa.concat_arrays([self.known, pa.array(new, pa.string())])
        self.starts = np.concatenate([self.starts, self.starts[-1] + sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes[-1]))])

    def encode_column(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each followed by ``end``, and where each text's begin."""
        lists = self._chunks(pc.fill_null(texts, ""))
        each = pc.dictionary_encode(lists.flatten())
        if len(self.known) > self.cached:
            self._empty()
        at = pc.index_in(each.dictionary, value_set=self.known)
        new = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        at = pc.fill_null(at, 0).to_numpy().copy()
        if len(new):
            at[new] = len(self.known) + np.arange(len(new))
            self._learn(each.dictionary.take(pa.array(new)).to_pylist())
        flat, ends = joined(self.flat, self.starts, at[each.indices.to_numpy()])
        ends = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return np.insert(flat, ends[1:], self.dtype.type(end)), ends + np.arange(len(ends))

    def encode(self, texts: Iterable[str | None], end: int) -> Iterator[np.ndarray]:
        """Ids of each text, then ``end``, as arrays of ``dtype``."""
        flat, starts = self.encode_column(pa.array(texts, pa.string()), end)
        yield from (flat[a:b] for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False))

    def batches(self, batch: pa.RecordBatch, end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """The batch in slices of about ``BYTES`` of text, with the ids of their texts and where they begin."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy())
        row = 0
        while row < batch.num_rows:
            done = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, done + BYTES, "right")))
            part = batch.slice(row, stop - row)
            yield part, *self.encode_column(part["text"], end)
            row = stop


def joined(flat: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``flat[starts[i]:starts[i + 1]]`` for i in ``at``, one after the other, and where they begin and end."""
    sizes = starts[at + 1] - starts[at]
    ends = np.append(0, np.cumsum(sizes))
    return flat[np.repeat(starts[at] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def forget() -> None:
    """Frees the caches of this worker; for steps that come after all ids are written."""
    encoder.cache_clear()


@lru_cache(maxsize=1)
def encoder(path: str, spaced: bool) -> Encoder:
    return Encoder(path, spaced)
