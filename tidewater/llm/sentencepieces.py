"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a word once. At each position it reports, along its output links,
every piece that ends there, and the Viterbi pass relaxes the position's best score from where the piece begins.
For a unigram model a score is the sum of piece scores. For a model of merges (BPE) the sum would pick other
pieces than merging does; there the step from the last piece a to the next piece b scores zero if merging the
characters of ab leaves a and b apart, and minus infinity if not. Exactly one path to each position then has a
finite score, and it is the result of merging, so the pieces are those of the library.

No piece holds a blank behind another character, nor a character that is no piece itself, so blanks and unknown
characters bound the words; words that return are remembered, and runs of blanks, which share one score, are merged by rule.
Unknown characters become the pieces of their UTF-8 bytes.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import map_texts

BLANK = "▁"
#: What an entry of a memo takes besides its characters and ids; a pair of pieces with its answer.
WORD_BYTES, APART_BYTES = 220, 200
#: Runs of up to so many blanks are remembered; longer ones are merged each time.
SHORT_RUN = 1024
#: Marks (a byte each) of words that were met; what can't follow the one blank of a word.
MARKS, NO_WORD = 1 << 21, ("", BLANK)
MADE = "n_ids int, ids array<int>, decoded_sha256 string, round_trip boolean"


class Pieces:
    """A model file's pieces with encode() and decode()."""

    def __init__(self, path: str, memo_bytes: int):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: only models with identity normalisation, a dummy prefix and byte pieces are supported")
        self.merging = proto.trainer_spec.model_type == 2
        self.memo_bytes, self.memo, self.held = memo_bytes, {}, 0
        self.marks, self.marked = bytearray(MARKS), 0
        self.shown = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(self.shown))]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.shown) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.shown) if not special[i] and i not in self.byte_of}
        self.letters = {p for p in self.ids if len(p) == 1}
        self.scores = [model.get_score(i) for i in range(len(self.shown))]
        self.hidden = frozenset(i for i, s in enumerate(special) if s)
        self.odd = self.hidden.union(self.byte_of)
        self.halves = self._halves() if self.merging else {}
        self.apart: list[dict[int, bool]] = [{} for _ in self.shown]  # by a piece and the one before it
        self.paired, self.pairs = set(), 0
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if not self.merging or len(piece) == 1 or i in self.halves:
                self.automaton.add_word(piece, (i, len(piece), self.apart[i]))
        self.automaton.make_automaton()
        inner = [p.lstrip(BLANK) for p in self.ids]
        if any(BLANK in p for p in inner) or any(c not in self.ids for p in self.ids for c in p) or any(p.startswith(BLANK * 2) and p.strip(BLANK) for p in self.ids):
            raise ValueError(f"{path}: pieces cross the bounds of words")
        self.word = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+" + ("|\n" if "\n" not in self.ids else ""))
        self.runs: dict[int, list[int]] = {}

    def _halves(self) -> dict[int, tuple[int, int]]:
        """The two pieces whose merging gives each piece, where merging its characters gives it at all."""
        found = {}
        for piece, i in self.ids.items():
            trail: list[tuple[str, str]] = []
            if len(piece) > 1 and self.merge(piece, trail) == [i]:
                found[i] = (self.ids[trail[-1][0]], self.ids[trail[-1][1]])
        return found

    def merge(self, text: str, trail: list | None = None) -> list[int]:
        """Merges characters, best score first and then leftmost; every character is a piece. Notes merges in trail."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (n := self.ids.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(queue, (-self.scores[n], i, parts[i], parts[after[i]]))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            if trail is not None:
                trail.append((a, b))
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.ids[p] for p in parts if p is not None]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of pieces a and b never joins the two.

        Merges are undone from the last on, at the bound between a and b. A joint piece that would have been merged
        before the one just undone came first; at the same score the one further left came first.
        """
        known = self.apart[b].get(a)
        if known is not None:
            return known
        scores, shown, ids, halves = self.scores, self.shown, self.ids, self.halves
        left, right, after, tie = a, b, -math.inf, False
        apart = None
        while apart is None:
            joint = ids.get(shown[left] + shown[right])
            if joint is not None and (scores[joint] > after or (tie and scores[joint] == after)):
                apart = False
                break
            l_halves, r_halves = halves.get(left), halves.get(right)
            if l_halves and (not r_halves or scores[left] < scores[right]):
                after, tie, left = scores[left], False, l_halves[1]
            elif r_halves:
                after, tie, right = scores[right], True, r_halves[0]
            else:
                apart = True
        if self.pairs * APART_BYTES > self.memo_bytes:
            for i in self.paired:
                self.apart[i].clear()
            self.paired, self.pairs = set(), 0
        self.apart[b][a] = apart
        self.paired.add(b)
        self.pairs += 1
        return apart

    def viterbi(self, text: str) -> list[int]:
        """The best pieces of known characters, in one pass over them."""
        n = len(text)
        last, size = [-1] * n, [0] * n  # of the path to a character's end
        if self.merging:  # scores are zero or minus infinity: a position's first finite score is its best
            for end, (piece, length, apart) in self.automaton.iter(text):
                if last[end] < 0:
                    if length <= end:
                        before = last[end - length]
                        known = apart.get(before)
                        if not (self._stay_apart(before, piece) if known is None else known):
                            continue
                    last[end], size[end] = piece, length
        else:
            best, scores = [-math.inf] * n + [0.0], self.scores  # the start is at -1
            for end, (piece, length, _) in self.automaton.iter(text):
                start = end - length
                if best[start] + scores[piece] > best[end]:
                    best[end], last[end], size[end] = best[start] + scores[piece], piece, length
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _word(self, word: str) -> list[int]:
        if self.letters.issuperset(word):
            return self.viterbi(word) if word else []
        out, known = [], []
        for c in word:
            if c in self.ids:
                known.append(c)
                continue
            if known:
                out += self.viterbi("".join(known))
                known = []
            out += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return out + (self.viterbi("".join(known)) if known else [])

    def _blanks(self, n: int) -> list[int]:
        known = self.runs.get(n)
        if known is None:
            known = self.merge(BLANK * n) if self.merging else self.viterbi(BLANK * n)
            if n <= SHORT_RUN:
                self.runs[n] = known
        return known

    def _met(self, chunk: str) -> bool:
        """Whether a word was met before, by a table of marks; most words come once, and would drive out those that return."""
        at = hash(chunk) % MARKS
        if self.marks[at]:
            return True
        if 2 * self.marked > MARKS:
            self.marks, self.marked = bytearray(MARKS), 0
        self.marks[at] = 1
        self.marked += 1
        return False

    def _chunk(self, chunk: str) -> list[int]:
        if chunk[0] == BLANK and chunk[1:2] not in NO_WORD:
            return self._word(chunk)
        word = chunk.lstrip(BLANK)
        lead = len(chunk) - len(word)
        known = self._word(BLANK + word if lead and word else word)
        if lead and word and known[0] == self.ids.get(BLANK):
            return self._blanks(lead) + known[1:]
        return self._blanks(lead - bool(word)) + known if lead > 1 or not word else known

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the library gives them; blanks and the mark for blanks are one."""
        if not text:
            return []
        out, memo = [], self.memo
        for chunk in self.word.findall(BLANK + text.replace(" ", BLANK)):
            known = memo.get(chunk)
            if known is None:
                known = self._chunk(chunk)
                # a number of 8 bytes a piece, and what strings, lists and the table take
                size = 4 * len(chunk) + 8 * len(known) + WORD_BYTES
                if size <= self.memo_bytes and self._met(chunk):
                    if self.held + size > self.memo_bytes:
                        memo.clear()
                        self.held = 0
                    memo[chunk] = known
                    self.held += size
            out += known
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Byte pieces that form no UTF-8 become replacement characters; control pieces are nothing."""
        shown, byte_of, hidden = self.shown, self.byte_of, self.hidden
        if self.odd.isdisjoint(ids):
            text = "".join(map(shown.__getitem__, ids))
        else:
            raw = b"".join(bytes([byte_of[i]]) if i in byte_of else b"" if i in hidden else shown[i].encode() for i in ids)
            text = raw.decode("utf-8", "replace")
        return text.replace(BLANK, " ")[1:] if text.startswith(BLANK) else text.replace(BLANK, " ")


@functools.cache
def _pieces(path: str, memo_bytes: int) -> Pieces:
    return Pieces(path, memo_bytes)


def encode_documents(docs: DataFrame, model_path: str, *, memo_bytes: int = 48_000_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_ids, ids, decoded_sha256, round_trip.

    decoded_sha256 is that of the text which the ids decode to; round_trip says whether it equals the input, the
    mark for blanks (U+2581) read as a blank. Null texts count as empty and have no ids. Repeated rows and null ids
    stay, an empty table gives no rows, other columns are not read. Row by row; nothing is shuffled. A worker remembers
    words in at most memo_bytes, and as much again of pairs of pieces.
    """

    def of(texts: list[str]) -> list:
        pieces = _pieces(model_path, memo_bytes)
        flat, offsets, digests, same = array("i"), array("i", [0]), [], []
        for source in texts:
            ids = pieces.encode(source)
            decoded = pieces.decode(ids)
            flat.extend(ids)
            offsets.append(len(flat))
            digests.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            same.append(decoded == source.replace(BLANK, " "))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
        return [pc.list_value_length(lists), lists, digests, same]

    return map_texts(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body")), "body", MADE, of)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of encoded rows (doc_id, ids); null ids decode to the empty text, ids out of range are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path, 0)
        for part in batches:
            texts = [pieces.decode(ids or []) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
