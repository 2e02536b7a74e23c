"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes one string of symbols, its spaces written as a mark and one mark before it.  No piece of
such a vocabulary has a mark behind another character, so the parts that begin with marks are encoded on
their own.  Within a part all pairs of neighbours that form a piece wait in an agenda ordered by score,
then by place; the best one is merged and the pairs it makes with its new neighbours join the agenda.
What is no piece in the end is written as its bytes.

Tasks work on Arrow batches in slices of bounded size and remember the ids of short parts.  Every part
that is not remembered is encoded by the agenda; the ids of the new parts of a slice are compared with those of
the sentencepiece library and decoded by it, and so is the whole first text of a slice; a difference ends the
job.  A document's decoded text is put together from what its parts' ids were decoded to: a part's ids are
whole characters, so none crosses two parts.  A vocabulary that is not of this kind is refused.

Defined results: a null text counts as empty, an empty one has no ids; equal rows get equal results;
marks in a text decode as spaces, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from voicelode.llm.common import small_batches, texts_of

MARK = "▁"
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
_ENDS = "\n\t.,;:!?()$%&*#|"
_PART = re.compile(f"{MARK}+[^{MARK}]*")
#: Parts whose ids a task remembers, and the longest of them.
REMEMBERED = 400_000
LONGEST = 48
#: Parts up to this length keep their agenda in a list.
SHORT = 40
_NEVER = float("inf")


def model_path() -> str:
    """The installed vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merged(part: str, rank: dict[str, float]) -> list[str]:
    """The symbols of a part after all merges, best score first, then leftmost."""
    return _merged_short(part, rank) if len(part) <= SHORT else _merged_long(part, rank)


def _merged_short(part: str, rank: dict[str, float]) -> list[str]:
    """With the agenda as a list in the order of places: for few symbols its minimum is found faster than in a heap."""
    symbols, get = list(part), rank.get
    agenda = [get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
    while agenda:
        best = min(agenda)
        if best == _NEVER:
            break
        i = agenda.index(best)
        pair = symbols[i] = symbols[i] + symbols.pop(i + 1)
        del agenda[i]
        if i < len(agenda):
            agenda[i] = get(pair + symbols[i + 1], _NEVER)
        if i:
            agenda[i - 1] = get(symbols[i - 1] + pair, _NEVER)
    return symbols


def _merged_long(part: str, rank: dict[str, float]) -> list[str]:
    """With the agenda as a heap, so that time is about linear."""
    symbols = list(part)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = []
    for i in range(n - 1):
        pair = symbols[i] + symbols[i + 1]
        if pair in rank:
            agenda.append((rank[pair], i, pair))
    heapq.heapify(agenda)
    while agenda:
        _, i, pair = heapq.heappop(agenda)
        j = after[i]
        if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = pair, ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            wider = pair + symbols[k]
            if wider in rank:
                heapq.heappush(agenda, (rank[wider], i, wider))
        if (h := before[i]) >= 0:
            wider = symbols[h] + pair
            if wider in rank:
                heapq.heappush(agenda, (rank[wider], h, wider))
    return [s for s in symbols if s]


class PieceModel:
    """A merge-type vocabulary and the library that results are checked against."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        count = range(lib.get_piece_size())
        normal = [i for i in count if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in normal}
        self.rank = {piece: -lib.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        odd = [p for p in self.ids if re.search(f"[^{MARK}]{MARK}", p)]
        if odd or not all(lib.is_byte(b) for b in self.bytes):
            raise ValueError(f"not a merge-type vocabulary with byte pieces and marks in front only: {odd[:5]}")
        # no merge crosses two characters that stand together in no piece: cut words from what ends them
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        ends = [c for c in _ENDS if not any(p[1] == c and _LETTER.match(p) for p in pairs)]
        starts = [c for c in _ENDS if not any(p[0] == c for p in pairs)]
        cuts = [f"(?<={_LETTER.pattern})(?=[{re.escape(''.join(ends))}])"] * bool(ends)
        cuts += [f"(?<=[{re.escape(''.join(starts))}])"] * bool(starts)
        self._cut = re.compile("|".join(cuts)).split if cuts else lambda part: [part]
        self._known: dict[str, str] = {}
        self._decoded: dict[str, str] = {}
        self._runs: dict[str, str] = {}

    def _encode_run(self, run: str) -> str:
        out = []
        for symbol in merged(run, self.rank):
            found = self.ids.get(symbol)
            if found is not None:
                out.append(found)
            else:
                out += [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]
        return ",".join(map(str, out))

    def encode_part(self, part: str) -> str:
        """The ids of a part, comma-joined, from its runs."""
        runs, out = self._runs, []
        for run in filter(None, self._cut(part)):
            ids = runs.get(run)
            if ids is None:
                ids = self._encode_run(run)
                if len(run) <= LONGEST:
                    if len(runs) > REMEMBERED:
                        runs.clear()
                    runs[run] = ids
            out.append(ids)
        return ",".join(out)

    def _check(self, text: str, ids: str) -> str:
        """The library's decoded text of these ids, which must be those it gives the text."""
        own = self.library.encode(text)
        if ",".join(map(str, own)) != ids:
            raise RuntimeError(f"ids differ from the library's: {text[:200]!r}")
        decoded = self.library.decode(own) if own else ""
        if decoded != text.replace(MARK, " "):
            raise RuntimeError(f"the decoded text differs from the library's: {text[:200]!r}")
        return decoded

    def _learn(self, parts: list[str]) -> None:
        """Remember ids and decoded text of parts (each without its first mark), both checked against the library."""
        learnt = {p: self.encode_part(MARK + p) for p in parts}
        decoded, together = {}, []
        for p in parts:  # the library puts the first mark there itself
            if p.strip(MARK):
                together.append(p)
            else:  # marks only: they would join those of the next part
                decoded[p] = " " + (self._check(" " * len(p), learnt[p]) if p else "")
        if together:
            text = self._check(" ".join(together).replace(MARK, " "), ",".join([learnt[p] for p in together]))
            at = 0
            for p in together:  # of what the library has decoded, the characters of each part
                end = at + len(p)
                decoded[p] = " " + text[at:end]
                at = end + 1
        self._known.update(learnt)
        self._decoded.update(decoded)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids, comma-joined; decoded text) of each text."""
        parts = []
        for text in texts:
            found = text.split(" ") if text else []
            if text and ("" in found or MARK in text):  # a part may begin with several marks
                found = [p[1:] for p in _PART.findall(MARK + text.replace(" ", MARK))]
            parts.append(found)
        if len(self._known) > REMEMBERED:
            self._known.clear()
            self._decoded.clear()
        new = list(set().union(*parts).difference(self._known))
        self._learn(new)
        find, written = self._known, self._decoded
        for n, (found, text) in enumerate(zip(parts, texts, strict=True)):
            ids = ",".join([find[p] for p in found])
            decoded = "".join([written[p] for p in found])[1:]
            if not n and self._check(text, ids) != decoded:
                raise RuntimeError(f"the decoded text differs from the library's: {text[:200]!r}")
            yield ids, decoded
        for p in new:
            if len(p) > LONGEST:
                del find[p], written[p]


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document (and ids, decoded)."""
    path = path or model_path()

    def encode(batches):
        model = PieceModel(path)
        for batch in small_batches(batches):
            ids, decoded = [], []
            count, ids_sha, decoded_sha = [], [], []
            for i, d in model.encode(texts_of(batch.column("text"))):
                count.append(i.count(",") + 1 if i else 0)
                ids_sha.append(hashlib.sha256(i.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in i.split(",")] if i else [])
                    decoded.append(d)
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(count, pa.int64()),
                "ids_sha256": pa.array(ids_sha, pa.string()),
                "decoded_sha256": pa.array(decoded_sha, pa.string()),
            }
            if with_ids:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(encode, schema + ", ids array<int>, decoded string" * with_ids)
