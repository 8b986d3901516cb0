"""The pieces of a SentencePiece BPE model as numpy tables, and the cut of texts into parts that no piece crosses."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

SPACE = "▁"  # the model's mark for a space
_PARTS = re.compile(r"\n| *[^ \n]+| +")


class PieceTable:
    """Ids, ranks and mergeable pairs of a model's pieces. Holds for BPE models with byte fallback and without text normalization."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = v = sp.get_piece_size()
        normal = [i for i in range(v) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i).replace(SPACE, " "): i for i in normal}
        if any(re.search("[^ ] ", p) for p in self.id_of) or sp.encode("ﬁＡ x", out_type=str)[1] == "fi":
            raise ValueError("pieces of this model cross words, or it normalizes texts; cutting texts at spaces would be wrong")
        self.byte_id = np.zeros(256, np.int32)
        for i in range(v):
            if sp.is_byte(i):
                self.byte_id[int(sp.id_to_piece(i)[1:-1], 16)] = i
        # equal scores share a rank: of those the leftmost pair goes first
        score = np.array([sp.get_score(i) for i in normal])
        self.rank = np.full(v + 1, np.iinfo(np.int32).max, np.int64)
        self.rank[normal] = np.unique(-score, return_inverse=True)[1]
        pairs = [(self.id_of[p[:k]] * (v + 1) + self.id_of[p[k:]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of]
        pairs.sort()
        self.pair = np.array([x for x, _ in pairs] or [-1], np.int64)
        self.merged = np.array([x for _, x in pairs] or [v], np.int64)
        self.near = np.array(sorted({ord(a) << 21 | ord(b) for p in self.id_of for a, b in zip(p, p[1:], strict=False)}) or [-1], np.int64)
        chars = sorted((ord(p), i) for p, i in self.id_of.items() if len(p) == 1)
        self.char = np.array([c for c, _ in chars] or [-1], np.int64)
        self.char_id = np.array([i for _, i in chars] or [v], np.int64)
        self._trie()
        self.bytes_of = [p.encode() for p in [""] * v]
        for p, i in self.id_of.items():
            self.bytes_of[i] = p.encode()
        for b, i in enumerate(self.byte_id):
            self.bytes_of[i] = bytes([b])

    def _trie(self) -> None:
        """Nodes of the pieces' prefixes: sorted (node, character) keys, their children, and the piece that ends at a node (-1: none)."""
        nodes, ends, keys = {"": 0}, [-1], []
        for p, i in self.id_of.items():
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    ends.append(-1)
                    keys.append((nodes[p[: k - 1]] << 21 | ord(p[k - 1]), nodes[p[:k]]))
            ends[nodes[p]] = i
        # open addressing: a key is at its hash's place or behind it, before the next free one
        self.places = 1 << (4 * len(keys) + 16).bit_length()
        self.trie_key, self.trie_child = np.full(self.places, -1, np.int64), np.full(self.places, -1, np.int64)
        for key, child in keys:
            k = int(self._place(np.array([key]))[0])
            while self.trie_key[k] >= 0:
                k = (k + 1) % self.places
            self.trie_key[k], self.trie_child[k] = key, child
        self.node_piece = np.array(ends, np.int64)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (self.places.bit_length() - 1))).astype(np.int64)

    def child_of(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node, or -1."""
        key = node << 21 | char
        at = self._place(key)
        there = self.trie_key[at]
        out = np.where(there == key, self.trie_child[at], -1)
        on = np.flatnonzero((there != key) & (there >= 0))
        while len(on):
            at[on] = (at[on] + 1) % self.places
            there = self.trie_key[at[on]]
            hit = there == key[on]
            out[on[hit]] = self.trie_child[at[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out

    def apart(self, code: np.ndarray) -> np.ndarray:
        """Places before which a text of these characters can be cut: no piece has the two characters there side by side."""
        key = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.near, key), len(self.near) - 1)
        return np.flatnonzero(self.near[at] != key) + 1

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, or size where there is none."""
        key = left * (self.size + 1) + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merged[at], self.size)


@lru_cache(maxsize=4)
def piece_table(path: str) -> PieceTable:
    """One per Python worker."""
    return PieceTable(path)


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts_of(text: str | None) -> list[str]:
    """The text behind the model's added first space, cut before each run of spaces and around each line feed: no piece crosses these cuts."""
    if not text:
        return []
    if "  " in text or text[0] == " " or "\x01" in text or "\n " in text or " \n" in text:
        return _PARTS.findall(" " + text)
    return [x for x in (" " + text).replace("\n", "\x01\n\x01").replace(" ", "\x01 ").split("\x01") if x]
