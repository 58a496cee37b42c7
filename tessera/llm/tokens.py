"""Token ids by the tokenizers library, with a cache of words in front of it.

For the files whose normaliser and cutting are known here, token boundaries always fall between white-space-separated
units, so a text's ids are its units' ids in a row. Arrow splits a batch of texts and numbers its distinct units. Distinct units of plain characters are cut by
the tokenizer's own pattern together; pieces that are not remembered go to the tokenizer's model. Any other
unit, and any text under any other file, goes through the whole tokenizer.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces of a generation that a worker remembers (two generations at most, some 60 MB each), bytes of text
#: that are split at a time, and units that are cut at a time.
REMEMBER, CHUNK, TOGETHER = 300_000, 8_000_000, 20_000
#: Letters whose normal form, case and class are plain, and the contractions that the patterns name.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: How the two known files normalise and cut.
WORDS_CUT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
BYTES_CUT = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
#: Between units that go to the model together, and between their pieces. No plain unit holds them.
STOP, COMMA = "\x00", "\x02"

ID = attrgetter("id")
#: What stands for STOP among ids: no id is as large.
MARK = b"\xff" * 4

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a file: its cache outlives a task."""
    if path not in _ENCODERS:
        # Millions of short-lived small objects, hardly a cycle among them: collect far less often.
        gc.set_threshold(200_000, 20, 100)
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write each byte as a printable character: itself, or the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return {b: chr(b if b in plain else next(other)) for b in range(256)}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        with open(path) as f:
            told = json.load(f)
        cuts = {k: told.get(k) for k in ("normalizer", "pre_tokenizer")}
        model = told["model"]
        simple = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        #: Whether white space only separates units, and whether the file is one of those known here.
        self.drops_space = cuts == WORDS_CUT
        self.known = simple and told.get("post_processor") is None and cuts in (WORDS_CUT, BYTES_CUT)
        self.special = [t["content"] for t in told["added_tokens"]]
        if any(t.get(k) for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(map(str.isspace, "".join(self.special))):
            self.known = False
        self.letters = _byte_letters()
        if self.drops_space:
            self.plain = re.compile(f"[!-~{LETTERS}]*")
            self.cut = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|{STOP}|[^0-9{LETTERS}{STOP}]+")
        else:
            self.plain = re.compile(f"[\n -~{LETTERS}]*")
            self.cut = re.compile(rf"{CONTRACTIONS}| ?[{LETTERS}]+| ?[0-9]+|{STOP}| ?[^\n 0-9{LETTERS}{STOP}]+|[\n ]+(?![^\n {STOP}])|[\n ]+")
        self.all_plain = re.compile(self.plain.pattern.replace("[", f"[{STOP}", 1)).fullmatch
        self.after_word = re.compile(r"(?<=\S) ")
        self.fresh: dict[str, bytes] = {STOP: MARK}
        self.older: dict[str, bytes] = {}

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All texts' units in a row, and where each text's begin and end. Their ids in a row are the texts'."""
        if not self.known:
            return texts, np.arange(len(texts) + 1)
        if self.drops_space:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        elif pc.any(odd := pc.match_substring_regex(texts, r"\x00|[\s\v\x1c-\x1f\x{85}\p{Z}]{2}"), min_count=0).as_py():
            # A run of white space keeps all but its last sign to itself: cut only behind words.
            each = [self._behind(t) if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
            lists = pc.if_else(odd, pa.array(each, pa.list_(pa.string())), self._singly(texts))
        else:
            lists = self._singly(texts)
        # An array made by parts may begin anywhere in its values.
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        return lists.flatten(), np.concatenate(([0], np.cumsum(sizes)))

    def _singly(self, texts: pa.Array) -> pa.Array:
        """Single spaces belong to the word behind them, single line ends to nobody."""
        apart = pc.replace_substring(pc.replace_substring(texts, "\n", "\x00\n\x00"), " ", "\x00 ")
        return pc.split_pattern(apart, "\x00")

    def _behind(self, text: str) -> list[str]:
        first, *rest = self.after_word.split(text)
        return [first, *[" " + x for x in rest]]

    def chunks(self, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Some texts at a time: their distinct units, the place there of each unit in a row, and each text's ends in that row.

        Nulls are empty.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK)))
            units, ends = self.units(texts.slice(at, upto - at))
            coded = units.dictionary_encode()
            yield coded.dictionary, coded.indices.to_numpy(), ends
            at = upto

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids."""
        for units, where, ends in self.chunks(texts):
            yield from _gathered(*self.flat(units), where, ends)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))

    def flat(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of different units in a row, and how many each has."""
        if not self.known:
            of = self._whole(units.to_pylist())
            return np.frombuffer(b"".join(of), "<u4"), np.fromiter(map(len, of), np.int32, len(of)) // 4
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int32)]
        for at in range(0, len(units), TOGETHER):
            some = units.slice(at, TOGETHER)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), STOP)[0].as_py() + STOP
            if self.all_plain(joined) and joined.count(STOP) == len(some) and not any(map(joined.__contains__, self.special)):
                more = self._modelled(joined)
            else:
                some = some.to_pylist()
                odd = [not self.plain.fullmatch(u) or any(map(u.__contains__, self.special)) for u in some]
                whole = iter(self._whole([u for u, o in zip(some, odd, strict=True) if o]))
                plain = STOP.join([*(u for u, o in zip(some, odd, strict=True) if not o), ""])
                got, n = self._modelled(plain) if plain else (np.zeros(0, "<u4"), [])
                plain = iter(np.split(got, np.cumsum(n)[:-1])) if len(n) else iter(())
                each = [np.frombuffer(next(whole), "<u4") if o else next(plain) for o in odd]
                more = np.concatenate(each), np.fromiter(map(len, each), np.int32, len(each))
            ids.append(more[0])
            sizes.append(more[1])
        return np.concatenate(ids), np.concatenate(sizes)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _modelled(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain units, each with STOP behind it, and how many each has: cut together, and each piece that is not remembered through the model."""
        pieces = self.cut.findall(joined.lower() if self.drops_space else joined)
        fresh, older, new, long = self.fresh, self.older, [], []
        for p in set(pieces).difference(fresh):
            if p in older:
                fresh[p] = older[p]
            else:
                new.append(p)
                if len(p) >= 64:
                    long.append(p)
        tokenize = self.full.model.tokenize
        spelt = COMMA.join(new).encode().decode("latin-1").translate(self.letters).split(self.letters[ord(COMMA)])
        for p, s in zip(new, spelt, strict=bool(new)):
            fresh[p] = array("I", map(ID, tokenize(s))).tobytes()
        raw = b"".join(map(fresh.__getitem__, pieces))
        ids = np.frombuffer(raw, "<u4")
        ends = np.flatnonzero(ids == 0xFFFFFFFF)
        for p in long:
            del fresh[p]
        if len(fresh) >= REMEMBER:
            self.fresh, self.older = {STOP: MARK}, fresh
        return ids[ids != 0xFFFFFFFF], (np.diff(ends, prepend=-1) - 1).astype(np.int32)


def _gathered(flat: np.ndarray, sizes: np.ndarray, where: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """Each text's ids: those of its units (``where``, up to its end) in a row. Some hundred thousand units at a time."""
    starts, at = np.cumsum(sizes, dtype=np.int64) - sizes, 0
    while at < len(ends) - 1:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER * 8, "right")) - 1)
        of = where[ends[at] : ends[upto]]
        n = sizes[of]
        after = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        ids = flat[np.repeat(starts[of] - after[:-1], n) + np.arange(after[-1])].tobytes()
        cuts = (4 * after[ends[at : upto + 1] - ends[at]]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield ids[a:b]
        at = upto
