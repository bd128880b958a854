"""Token ids of whole texts, memoised by word.

A byte-level or word-end BPE never merges across a pre-token border, and both kinds put such a border at a
single space or line break that stands between two other characters. So a text is cut there and nowhere
else, each distinct piece is encoded once by the tokenizers library, and a document is the concatenation of
its pieces. Pieces repeat far more often than documents do, so most of the work is a dictionary lookup.
"""

from __future__ import annotations

import os
import re
from itertools import chain, islice

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; read at the library's first use

import numpy as np  # noqa: E402
from tokenizers import Tokenizer, normalizers, pre_tokenizers  # noqa: E402

from gridloom.llm.common import held  # noqa: E402

#: White space that does more than separate two words; texts that have it are cut at fewer places.
_ODD = ["  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
_ODD_ASCII = [x for x in _ODD if x.isascii()]
#: Marks that a tokenizer that drops white space parts from a word before them; an apostrophe may stay with letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordEncoder:
    """Encodes batches of texts to little-endian unsigned 32-bit ids.

    ``spaced``: the tokenizer keeps a word's leading space (byte-level BPE); False for one that drops white
    space. ``limit`` bounds the memo: when it is full, all but the pieces met first, among them the common
    ones, are forgotten and learnt anew when they return.
    """

    def __init__(self, path: str, spaced: bool, limit: int = 1_200_000):
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.lead, self.limit, self.memo = " " if spaced else "", limit, {}
        self.bar = "\n" if spaced else "\x01"  # between pieces that are encoded together
        (self.bar_id,) = self.tok.encode(self.bar, add_special_tokens=False).ids
        # the same model for pieces that are letters only, and so one pre-token: no pattern has to find its borders
        self.word = Tokenizer.from_file(path)
        self.word.encode_special_tokens = True
        self.word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n" if spaced else " "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if not spaced:
            self.word.normalizer = normalizers.Lowercase()
            # and for ASCII letters in lower case, which need no normalizer and no map of bytes; its cache is no use to pieces met once
            self.ascii = Tokenizer.from_file(path)
            self.ascii.encode_special_tokens = True
            self.ascii.normalizer = normalizers.Sequence([])
            self.ascii.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.ascii.model._resize_cache(0)
        vocab = self.tok.get_vocab()
        self.border = np.zeros(max(vocab.values()) + 1, bool)
        self.border[[i for t, i in vocab.items() if (t[0] == "\u0120" if spaced else t.endswith("</w>"))]] = True

    def _pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in (_ODD_ASCII if text.isascii() else _ODD)):
            return _CUT.split(text)
        # a line break stays with the word after it where white space is kept
        if self.lead:
            return text.replace("\n", " \n").split(" ")
        # such a tokenizer lowers case itself; within Latin-1 that is str.lower, and composition changes nothing
        return (text.lower() if _latin(text) else text).replace("\n", " ").split(" ")

    def _learn(self, pieces: list[str]) -> None:
        """Encodes many pieces as one text, cut again at a bar that no other piece can give."""
        plain, joint, alone, ended = [], [], [], []
        for p in pieces:
            if p.isalpha() and (self.lead or _latin(p)):
                plain.append(p)
            elif not self.lead and (word := p.rstrip(_MARKS)).isalpha() and word.isascii():
                ended.append((p, word, p[len(word) :]))
            else:
                own = p[1:] if self.lead and p[:1] == "\n" else p
                (alone if len(own.split()) != 1 or own[0].isspace() or own[-1].isspace() or self.bar in own else joint).append(p)
        for piece, enc in zip(alone, self.tok.encode_batch_fast([p if p[:1] == "\n" and self.lead else self.lead + p for p in alone], add_special_tokens=False)):
            self.memo[piece] = np.array(enc.ids, "<u4").tobytes()
        if not self.lead:
            # such a tokenizer parts a word from the marks after it, so both are encoded on their own, each once
            own: dict[str, bytes] = {}
            self._plain([p for p in {w for _, w, _ in ended} if p not in self.memo], own)
            self._joint(self.tok, " \x01 ", self.bar_id, [p for p in {m for _, _, m in ended} if p not in self.memo], into=own)
            for piece, *both in ended:
                self.memo[piece] = b"".join([own[x] if x in own else self.memo[x] for x in both])
        self._plain(plain, self.memo)
        if not self.lead:
            self._joint(self.tok, " \x01 ", self.bar_id, joint)
        else:  # "\n" opens every piece; it belongs to those that begin with it
            self._joint(self.tok, "\n ", self.bar_id, [p for p in joint if p[0] != "\n"])
            self._joint(self.tok, "", self.bar_id, [p for p in joint if p[0] == "\n"], own=True)

    def _plain(self, pieces: list[str], memo: dict[str, bytes]) -> None:
        """Pieces of letters only: the tokens themselves tell where a word begins, or ends."""
        if self.lead:
            self._words(self.word, pieces, memo)
        else:
            self._words(self.ascii, [p for p in pieces if p.isascii()], memo, lower=True)
            self._words(self.word, [p for p in pieces if not p.isascii()], memo)

    def _words(self, tok: Tokenizer, pieces: list[str], memo: dict[str, bytes], lower: bool = False) -> None:
        at, gap = 0, "\n " if self.lead else " "
        texts = [gap[1:] + gap.join(pieces[i : i + 512]) for i in range(0, len(pieces), 512)]
        texts = [t.lower() for t in texts] if lower else texts
        for i in range(0, len(texts), 32):
            for enc in tok.encode_batch_fast(texts[i : i + 32], add_special_tokens=False):
                ids = np.array(enc.ids, "<u4")
                raw, cuts = ids.tobytes(), (4 * np.flatnonzero(self.border[ids])).tolist()
                starts, ends = (cuts, [*cuts[1:], len(raw)]) if self.lead else ([0, *(c + 4 for c in cuts[:-1])], [c + 4 for c in cuts])
                for piece, a, b in zip(pieces[at : at + len(starts)], starts, ends):
                    memo[piece] = raw[a:b]
                at += len(starts)
        assert at == len(pieces)

    def _joint(self, tok: Tokenizer, bar: str, bar_id: int, pieces: list[str], own: bool = False, into: dict[str, bytes] | None = None) -> None:
        memo, at = self.memo if into is None else into, 0
        texts = ["".join([bar + p for p in pieces[i : i + 512]]) for i in range(0, len(pieces), 512)]
        for i in range(0, len(texts), 32):
            for enc in tok.encode_batch_fast(texts[i : i + 32], add_special_tokens=False):
                ids = np.array(enc.ids, "<u4")
                raw, bars = ids.tobytes(), np.flatnonzero(ids == bar_id)
                starts, ends = (4 * bars + 4 * (not own)).tolist(), [*(4 * bars[1:]).tolist(), len(raw)]
                for piece, a, b in zip(pieces[at : at + len(starts)], starts, ends):
                    memo[piece] = raw[a:b]
                at += len(starts)
        assert at == len(pieces)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; null is empty."""
        cut = [self._pieces(t) for t in texts]
        heads = [b""] * len(texts)
        if self.lead:  # the first piece has no space before it
            heads = [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast([c[0] if c else "" for c in cut], add_special_tokens=False)]
            cut = [c[1:] for c in cut]
        out, memo = [], self.memo
        for at in range(0, len(cut), 64):
            flat = list(chain.from_iterable(cut[at : at + 64]))
            found = list(map(memo.get, flat))
            lacking = [i for i, v in enumerate(found) if v is None]
            if lacking:
                new = {flat[i] for i in lacking}
                if len(memo) + len(new) > self.limit:
                    old = dict(islice(memo.items(), self.limit // 2))
                    memo.clear()
                    memo.update(old)
                self._learn(list(new))
                for i in lacking:
                    found[i] = memo[flat[i]]
            place = 0
            for head, pieces in zip(heads[at : at + 64], cut[at : at + 64]):
                out.append(head + b"".join(found[place : place + len(pieces)]))
                place += len(pieces)
        return out


#: Pieces that an encoder remembers if nothing else is said; about 200 bytes each.
MEMO = 1_200_000


def encoder(path: str, spaced: bool, memo: int = MEMO) -> WordEncoder:
    """One encoder for each Python worker."""
    return held(("encoder", path, spaced, memo), lambda: WordEncoder(path, spaced, memo))
