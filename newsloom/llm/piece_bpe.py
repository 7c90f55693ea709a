"""Piece encoding and decoding: exact merge-type (BPE) ids by backtracking, distributed over documents.

A text is cut where a non-blank is followed by a blank (no piece crosses such a place) and where a
character has no piece. In a part, Aho-Corasick finds the longest piece that starts at each place;
a piece may follow another only if merging their joint text again gives just these two; a place from
which no piece fits is marked in a bit field and never tried again. Runs of blanks tie in score, so they
are merged as the library does, leftmost pair first.

Defined cases: a null text counts as empty; an empty text has the begin and end ids only and decodes to
an empty text; repeated rows are encoded each; texts of any length are encoded whole.
"""

from __future__ import annotations

import struct
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import add_columns, over_batches

BLANK, BREAK = "▁", "\n"
#: Entries kept per worker for parts and for pairs; a full table is emptied. They change speed only.
PART_CACHE, PAIR_CACHE, LONGEST_CACHED = 600_000, 400_000, 40

_models: dict[str, Pieces] = {}


class Pieces:
    """The vocabulary of a piece model of the BPE type with byte pieces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        ids = range(model.get_piece_size())
        normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in normal}
        self.score = {piece: model.get_score(i) for piece, i in self.id_of.items()}
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        alphabet = {c for piece in self.id_of for c in piece}
        if not alphabet <= self.id_of.keys() or BREAK in alphabet or any(BLANK in p.lstrip(BLANK) for p in self.id_of) or len(self.byte_id) != 256:
            raise ValueError("needs all characters but line ends, and all bytes, as pieces, and blanks at the start of pieces only")
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id_of), None) for p in self.id_of}
        self.search = ahocorasick.Automaton()
        for piece in self.id_of:
            self.search.add_word(piece, (len(piece) - 1, piece))
        self.search.make_automaton()
        self.text_of = {i: p.replace(BLANK, " ").encode() for p, i in self.id_of.items()}
        self.text_of |= {i: bytes([b]) for b, i in self.byte_id.items()}
        self.text_of |= {i: b"" for i in ids if model.is_control(i)}
        self.text_of[self.unknown] = " ⁇ ".encode()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {}
        self.split: dict[str, tuple[str, str]] = {}

    def merged(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, the leftmost among equals; notes the pairs in ``steps``."""
        parts: list[str | None] = list(text)
        before, after = [*range(-1, len(parts) - 1)], [*range(1, len(parts)), -1]

        def pair(i: int):
            both = parts[i] + parts[after[i]]
            return (-self.score[both], i, both) if both in self.score else None

        heap = [x for i in range(len(parts) - 1) if (x := pair(i))]
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            if parts[i] is None or (j := after[i]) < 0 or parts[i] + parts[j] != both:
                continue
            if steps is not None:
                steps.append((parts[i], parts[j]))
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if x := pair(i):
                    heappush(heap, x)
            if before[i] >= 0 and (x := pair(before[i])):
                heappush(heap, x)
        return [p for p in parts if p is not None]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joint text again gives just these two pieces.

        The merges of both are replayed from the last to the first. Before each, the pieces that touch
        the border stood side by side; if their joint piece scores better than that merge, merging
        would have crossed the border. The later of the two last merges is undone first; of equals, the
        right one, as leftmost pairs merge first.
        """
        if (found := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            found = self.pairs[left, right] = self._compatible(left, right)
        return found

    def _compatible(self, left: str, right: str) -> bool:
        score, ended, ended_right = self.score, float("-inf"), False
        while True:
            both = score.get(left + right)
            if both is not None and (both > ended or (both == ended and ended_right)):
                return False
            if len(left) == 1 and len(right) == 1:
                return True
            ended_right = len(left) == 1 or (len(right) > 1 and score[left] >= score[right])
            if ended_right:
                ended, right = score[right], self.halves(right)[0]
            else:
                ended, left = score[left], self.halves(left)[1]

    def halves(self, piece: str) -> tuple[str, str]:
        """The two pieces of the merge that completes a piece."""
        if piece not in self.split:
            self.merged(piece, steps := [])
            self.split[piece] = steps[-1]
        return self.split[piece]

    def longest(self, text: str) -> list[str | None]:
        """The longest piece that starts at each place."""
        out: list[str | None] = [None] * (len(text) + 1)
        for last, (less, piece) in self.search.iter(text):
            out[last - less] = piece  # ends come in order, so the longest is the last
        return out

    def backtracked(self, longest: list[str | None], start: int) -> tuple[list[str], int]:
        """From ``start`` to the next place without a piece: the one sequence of pieces whose neighbours
        are all compatible, and its end."""
        piece = longest[start]
        failed = 0  # the bit field: places from which no piece fits
        out, at, previous, pairs = [], start, None, self.pairs
        while True:
            end = at + len(piece)
            if not failed >> end - start & 1 and (previous is None or (
                    fits if (fits := pairs.get((previous, piece))) is not None else self.compatible(previous, piece))):
                out.append(piece)
                if longest[end] is None:
                    return out, end
                at, previous, piece = end, piece, longest[end]
            elif (shorter := self.shorter[piece]) is not None:
                piece = shorter
            else:
                failed |= 1 << at - start
                piece = out.pop()
                at -= len(piece)
                previous = out[-1] if out else None

    def ids(self, text: str, longest: list[str | None], at: int, end: int) -> list[int]:
        ids: list[int] = []
        while at < end:
            if longest[at] is None:
                ids += [self.byte_id[b] for b in text[at].encode("utf-8", "replace")]
                at += 1
            else:
                found, at = self.backtracked(longest, at)
                ids += map(self.id_of.__getitem__, found)
        return ids

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of a blank and each word, from one search over all; short words are kept for later texts."""
        text = BREAK.join([BLANK + w for w in words])
        longest, at, found = self.longest(text), 0, {}
        for word in words:
            ids = self.ids(text, longest, at, at + len(word) + 1)
            found[word] = struct.pack(f"<{len(ids)}I", *ids)
            at += len(word) + 2
        if len(self.parts) >= PART_CACHE:
            self.parts.clear()
        self.parts.update((w, x) for w, x in found.items() if len(w) <= LONGEST_CACHED)
        return found

    def blanks_and(self, blanks: int, word: str) -> bytes:
        """Ids of several blanks and perhaps a word. Pieces of blanks alone score below all others, so the
        last blank joins the word first, if it does; the others, and it if it stays alone, are merged then."""
        text = BLANK + word
        rest = self.ids(text, self.longest(text), 0, len(text)) if word else []
        if not rest or rest[0] == self.id_of[BLANK]:
            run, rest = blanks, rest[1:]
        else:
            run = blanks - 1
        ids = [self.id_of[p] for p in self.merged(BLANK * run)] + rest
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """All ids as little-endian unsigned 32-bit integers, begin and end included."""
        out = [struct.pack("<I", self.begin)]
        if text:
            known, blanks, words = self.parts, 1, text.replace(" ", BLANK).split(BLANK)
            new = {w for w in words if w not in known}
            new.discard("")
            fresh = self.learn(new) if new else {}
            for word in words:
                if not word:
                    blanks += 1
                elif blanks == 1:
                    out.append(known.get(word) or fresh.get(word) or self.learn({word})[word])
                else:
                    out.append(self.blanks_and(blanks, word))
                    blanks = 1
            if blanks > 1:
                out.append(self.blanks_and(blanks - 1, ""))
        out.append(struct.pack("<I", self.end))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.text_of.__getitem__, memoryview(ids).cast("I")))
        if raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join(c if not 0xDC80 <= ord(c) <= 0xDCFF else "�" for c in raw.decode("utf-8", "surrogateescape"))


def pieces(path: str) -> Pieces:
    """The vocabulary at ``path``, loaded once per worker."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``ids`` (binary: little-endian unsigned 32-bit integers with begin and end ids), ``n_tokens``
    and ``decoded`` (the text that the ids decode to) for every row."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.BinaryType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    def rows(batch):
        vocabulary = pieces(model_path)
        for k, t in batch:
            ids = vocabulary.encode(t)
            yield k, ids, len(ids) // 4, vocabulary.decode(ids)

    return over_batches(docs, [key, text], schema, rows)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result of query op4: counts and digests of ids and decoded text."""
    return add_columns(encoded.select(key, "n_tokens", "ids", "decoded"), {
        "ids_sha256": F.sha2(F.col("ids"), 256), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
    }).drop("ids", "decoded")
