"""Units of the public BPE tokenizers that are encoded by themselves, each once.

A BPE tokenizer splits a text into pre-tokens and encodes each by itself, so a text's ids are the ids of its pre-tokens
in a row. No pre-token of the two tokenizers here goes on after a space: a space is only ever the first character of one
(byte level) or dropped (word level). So a text may be cut at spaces, and the pieces of text between, each with its
pre-tokens, encoded apart; the exception is a space next to other white space at byte level, which is left to the library.
Natural text repeats few such units often, and a bounded memo makes the tokenizers library encode each about once per
Python worker. Texts are cut here only if all their characters belong to a set on which every Unicode version and both
pattern engines agree (ASCII, Latin letters to U+024F, common punctuation) and they hold none of the tokenizer's special
strings. Of every other text the library finds the pre-tokens, or encodes it as a whole, so results are the library's for
any text.
"""

from __future__ import annotations

import functools
import os
import re

#: The split patterns in the two tokenizer files.
PATTERNS = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
_CONTROL = re.compile("[^\t\n\r\x20-\x7e]")
_UNSURE = re.compile("[^\t\n\r\x20-\x7e¡-įı-ɏ‐-‧]")
#: The word-level pattern on that set, for the standard library's engine, which is twice as fast there.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_PLAIN = {"word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"), "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")}
#: Units kept by a worker, their characters, the longest kept: under 60 MB. Units that go to the library as one text.
UNITS, UNIT_BYTES, LONGEST, JOINED = 1_000_000, 16 << 20, 64, 2000


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name is looked up where this machine has the public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PreTokens:
    """Splits texts of one tokenizer and encodes pre-tokens. kind: which pattern its file has; value: ids → what is kept."""

    def __init__(self, name: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # Pre-tokens are normalised already; doing so again could change some (marks in another order).
        self.bare = Tokenizer.from_str(self.tokenizer.to_str())
        self.bare.normalizer = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.lower = "Lowercase" in str(spec["normalizer"])
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"] or {}]
        if steps[0].get("pattern", {}).get("Regex") == PATTERNS["word"] and self.lower:
            self.kind = "word"
        elif steps[0].get("type") == "ByteLevel" and steps[0]["use_regex"] and not steps[0]["add_prefix_space"] and not spec["normalizer"]:
            self.kind = "byte"
        else:
            self.kind = None
        blanks = r"  |\n |\t |\r |" if self.kind == "byte" else ""
        self.unsure = blanks + _UNSURE.pattern + "".join("|" + re.escape(x) for x in self.special)
        self.find_plain = _PLAIN[self.kind].findall if self.kind else None

    def plain(self, text: str) -> bool:
        """Whether a text may be taken apart here; else the library must see it whole."""
        if not self.kind or any(x in text for x in self.special):
            return False
        return not (_CONTROL.search(text) if text.isascii() else _UNSURE.search(text))

    def find(self, text: str) -> list[str] | None:
        """The pre-tokens themselves, or None where the library must see the text whole."""
        if self.plain(text):
            return self.find_plain(text.lower() if self.lower else text)
        if not self.kind or any(x in text for x in self.special):
            return None
        t = self.tokenizer
        plain = t.normalizer.normalize_str(text) if t.normalizer else text
        return [plain[a:z] for _, (a, z) in t.pre_tokenizer.pre_tokenize_str(plain)]

    def whole(self, unit: str) -> str:
        """The text that a unit stands for: at byte level the space before it belongs to it, but for the first of a text,
        which a leading \\x00 marks."""
        return unit if self.kind == "word" else unit[1:] if unit[:1] == "\x00" else " " + unit

    def pieces(self, parts: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        return [e.ids for e in self.bare.encode_batch_fast(parts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.cache
def pretokens(name: str) -> PreTokens:
    """One for each Python worker."""
    return PreTokens(name)


class Memo:
    """Encodes texts of a byte-level tokenizer, each distinct unit about once. Units and their ids are kept as columns: the
    first UNITS a worker meets, which are the frequent ones. Unknown units of a slice of texts go to the library together,
    joined by spaces; there each begins with a token that begins with a space, and no other token does, so the ids part
    again by looking at the tokens alone. A tokenizer of another kind, or a text that may not be cut, goes to the library
    whole."""

    def __init__(self, name: str, dtype: str):
        import numpy as np
        import pyarrow as pa

        self.p, self.dtype, self.room = pretokens(name), np.dtype(dtype), UNIT_BYTES
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        vocabulary = self.p.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # the token begins with a space
        self.opens[[k for x, k in vocabulary.items() if x[:1] == "\u0120"]] = True
        self.cuts = self.p.kind == "byte" and not any(" " in x for x in self.p.special)

    def _library(self, texts: list[str]):
        """(ids of all texts in a row, number of ids of each)."""
        import numpy as np

        lists = [e.ids for e in self.p.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.array(x, self.dtype) for x in lists]) if lists else np.zeros(0, self.dtype), np.fromiter(map(len, lists), np.int64, len(lists))

    def _binary(self, flat, end):
        """Ids in a row, and where each row of them ends, as a binary array."""
        import numpy as np
        import pyarrow as pa

        offsets = np.append(0, end) * self.dtype.itemsize
        return pa.BinaryArray.from_buffers(pa.binary(), len(end), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(np.ascontiguousarray(flat))])

    def _learn(self, units):
        """The ids of distinct units, in the same order."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        alone = pc.match_substring_regex(units, r"^$|^\x00|[\t\n\r]$").to_numpy(zero_copy_only=False)
        rest, single = np.flatnonzero(~alone), np.flatnonzero(alone)
        words = units.take(pa.array(rest))
        ends = np.append(np.arange(0, len(words), JOINED), len(words)).astype(np.int32)
        flat, _ = self._library([" " + x for x in pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), " ").to_pylist()])
        first = np.flatnonzero(self.opens[flat])
        if len(first) != len(words):  # the library cut differently than expected: one by one
            flat, n = self._library([" " + x for x in words.to_pylist()])
            first = np.cumsum(n) - n
        more, n = self._library([self.p.whole(x) for x in units.take(single).to_pylist()])
        if not len(single):
            return self._binary(flat, np.append(first[1:], len(flat)))
        both = pa.concat_arrays([self._binary(flat, np.append(first, len(flat))[1:]), self._binary(more, np.cumsum(n))])
        return both.take(pa.array(np.argsort(np.concatenate([rest, single]), kind="stable")))

    def _of(self, units):
        """The ids of distinct units, from what is kept or from the library."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(units, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        if not new.any():
            return self.ids.take(at)
        unknown = units.filter(pa.array(new))
        learned = self._learn(unknown)
        at = pc.fill_null(at, 0).to_numpy().copy()
        at[new] = len(self.known) + np.arange(len(unknown))
        out = pa.concat_arrays([self.ids, learned]).take(pa.array(at))
        length = pc.binary_length(unknown).to_numpy()
        keep = (length <= LONGEST) & (np.arange(len(length)) < UNITS - len(self.known))
        keep &= np.cumsum(np.where(keep, length, 0)) <= self.room
        if keep.any():
            self.room -= int(length[keep].sum())
            self.known = pa.concat_arrays([self.known, unknown.filter(pa.array(keep))])
            self.ids = pa.concat_arrays([self.ids, learned.filter(pa.array(keep))])
        return out

    def encode_array(self, texts):
        """The ids of each text of a string array, as a binary array."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        unsure = pc.match_substring_regex(texts, self.p.unsure).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        odd = unsure.any()
        plain = texts.filter(pa.array(~unsure)) if odd else texts
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\x00"), plain, ""), " ")
        numbered = lists.flatten().dictionary_encode()
        ids = self._of(numbered.dictionary).take(numbered.indices)
        # The units' ids stand in a row, so those of a text do.
        offsets = np.frombuffer(ids.buffers()[1], "<i4", len(ids) + 1, 4 * ids.offset) if len(ids) else np.zeros(1, "<i4")
        ends = offsets[lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)]
        out = pa.BinaryArray.from_buffers(pa.binary(), len(plain), [None, pa.py_buffer(ends), ids.buffers()[2] if len(ids) else pa.py_buffer(b"")])
        if not odd:
            return out
        flat, n = self._library(texts.filter(pa.array(unsure)).to_pylist())
        place = np.argsort(np.concatenate([np.flatnonzero(~unsure), np.flatnonzero(unsure)]), kind="stable")
        return pa.concat_arrays([out, self._binary(flat, np.cumsum(n))]).take(pa.array(place))

    def encode(self, text: str) -> bytes:
        import pyarrow as pa

        return self.encode_array(pa.array([text]))[0].as_py()


@functools.cache
def memo(name: str, dtype: str) -> Memo:
    """One for each Python worker."""
    return Memo(name, dtype)
