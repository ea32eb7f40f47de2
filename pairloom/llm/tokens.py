"""Token ids of whole texts, word by word.

The tokenizer drops white space and never joins what it parts, so a text's ids are its words' ids in
order. Words recur, so each worker keeps the ids of words it has met (at most KEEP_WORDS, then the half
met most often stays), and an Arrow batch is encoded by its distinct words. Nor does the tokenizer join
letters with a stop behind them, or tell A-Z from a-z in a plain word, so "Word." has the ids of "word"
and of ".". Plain words are encoded many at a time, with spaces between them: each ends in the one token
that bears the end-of-word mark. All other words are encoded one by one, as they are.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

KEEP_WORDS = 250_000
TOGETHER = 512
ENCODE_ROWS, ENCODE_BYTES = 768, 4 << 20  # in an Arrow batch, and encoded at once: the more, the fewer times a word is looked up
#: Latin letters whose small forms are one letter each.
PLAIN = "^[a-zÀ-ÖØ-öø-įı-ɏ]+$"
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Growing:
    """An array to which is added at the end, without a copy each time."""

    def __init__(self, dtype, first=()):
        self.held, self.n = np.zeros(1024, dtype), 0
        self.extend(np.array(first, dtype))

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(self.n // 2 + len(more), self.held.dtype)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def now(self) -> np.ndarray:
        return self.held[: self.n]


class WordIds:
    """Ids of words by one vocabulary file: a table of words met and their ids end to end. Its first rows are the empty word and the stops."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.clear()
        self.one_by_one(["", ".", ","])

    def clear(self) -> None:
        import pyarrow as pa

        self.words = pa.array([], pa.large_string())
        self.ids, self.ends, self.hits = Growing(np.int32), Growing(np.int32, [0]), Growing(np.int32)

    def add(self, words, ids: np.ndarray, lengths: np.ndarray) -> None:
        import pyarrow as pa

        self.words = pa.concat_arrays([self.words, words])
        self.ends.extend(self.ids.n + np.cumsum(lengths))
        self.ids.extend(ids)
        self.hits.extend(np.zeros(len(words), np.int32))

    def one_by_one(self, words: list[str]) -> None:
        import pyarrow as pa

        met = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, met), np.int64, len(met))
        self.add(pa.array(words, pa.large_string()), np.fromiter(chain.from_iterable(met), np.int32, int(lengths.sum())), lengths)

    def together(self, words) -> None:
        """For an Arrow array of plain words."""
        cuts, names = np.append(np.arange(0, len(words), TOGETHER), len(words)), words.to_pylist()
        joined = [" ".join(names[k : k + TOGETHER]) for k in cuts[:-1].tolist()]
        ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate(ids)
        ends = np.flatnonzero(self.last[flat])
        whole = np.cumsum([len(i) for i in ids]) - 1
        if len(ends) == len(words) and (ends[cuts[1:] - 1] == whole).all():
            self.add(words, flat, np.diff(ends, prepend=-1))
        else:
            self.one_by_one(names)

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of the table, end to end, and where each row's end, from a 0 on."""
        ends = self.ends.now
        starts = ends[at]
        lengths = ends[1:][at] - starts
        out = np.concatenate([[0], np.cumsum(lengths)])
        place = np.repeat((starts - out[:-1]).astype(np.int32), lengths)  # 32 bits do for a slice of a batch
        place += np.arange(out[-1], dtype=np.int32)
        return self.ids.now[place], out

    def shrink(self) -> None:
        """Keeps the half of the words met most often, and the first rows."""
        import pyarrow as pa

        keep = np.argsort(-self.hits.now[3:], kind="stable")[: KEEP_WORDS // 2] + 3
        keep = np.concatenate([[0, 1, 2], np.sort(keep)])
        words, hits = self.words.take(pa.array(keep)), self.hits.now[keep] // 2
        ids, ends = self.rows(keep)
        self.clear()
        self.add(words, ids, np.diff(ends))
        self.hits.now[:] = hits

    def places(self, plain, odd) -> np.ndarray:
        """Rows of distinct words, plain ones and then odd ones, after adding those that are new."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.words) > KEEP_WORDS:
            self.shrink()
        at = pc.fill_null(pc.index_in(pa.concat_arrays([plain, odd]), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        n = len(plain)
        before = len(self.words)
        if new[:n].any():
            self.together(plain.filter(pa.array(new[:n])))
        if new[n:].any():
            self.one_by_one(odd.filter(pa.array(new[n:])).to_pylist())
        at[new] = np.arange(before, len(self.words))
        self.hits.now[at] += 1
        return at

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of texts (null: none), and where each text's ids end, from a 0 on."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = split.offsets.to_numpy()
        words = split.flatten()
        core = pc.ascii_rtrim(words, characters=".,")
        coded = pc.ascii_lower(core).dictionary_encode()
        simple = pc.match_substring_regex(coded.dictionary, PLAIN).to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        cut = pc.binary_length(words).to_numpy() - pc.binary_length(core).to_numpy()
        odd = cut > 1
        if len(codes):
            odd |= ~simple[codes]
        strange = words.filter(pa.array(odd)).dictionary_encode()
        used = np.zeros(len(simple), bool)
        used[codes[~odd]] = True
        at = self.places(coded.dictionary.filter(pa.array(used)), strange.dictionary)
        n = int(used.sum())
        row = np.full(len(simple), -1)
        row[used] = at[:n]
        both = np.zeros((len(words), 2), np.int64)  # a word, and its stop or the empty word
        both[~odd, 0] = row[codes[~odd]]
        both[odd, 0] = at[n:][strange.indices.to_numpy(zero_copy_only=False)]
        stop = (cut == 1) & ~odd
        if stop.any():
            flat, ends = np.frombuffer(words.buffers()[2], np.uint8), np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 : words.offset + 1 + len(words)]
            both[stop, 1] = np.where(flat[ends[stop] - 1] == ord("."), 1, 2)
        ids, ends = self.rows(both.ravel())
        return ids, ends[2 * (offsets - offsets[0])]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
