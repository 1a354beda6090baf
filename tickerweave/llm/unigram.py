"""A unigram reading of a SentencePiece vocabulary: Viterbi with Aho-Corasick.

The pieces and scores of a ``.model`` file are taken as a unigram language
model: a text's segmentation is the one with the largest sum of scores. Scores
add up exactly (float64; they are integers in the public file). Ties go, as in
the tokenizer's own search, to the piece that starts first. A character that
no one-character piece covers costs the least score minus 10 and falls back to
its bytes. Text is read as the model's normaliser does it: a space before the
text, spaces as U+2581, nothing else changed; the empty text has no tokens.

A piece holds U+2581 only at its start, so no piece crosses from a word into
the next: a text's best path is its words' best paths one after the other.
That is what makes remembering words exact.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def vocabulary(path: str = MODEL) -> dict:
    """What the workers need of a model file: pieces, scores, byte ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte, raw = [], [0] * 256, []
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte[int(text[3:5], 16)] = i
            raw.append(bytes([int(text[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unused(i) or sp.is_unknown(i):
            raw.append(b"")
        else:
            pieces.append((text, float(sp.get_score(i)), i))
            raw.append(text.replace(SPACE, " ").encode())
    return {"pieces": pieces, "byte": byte, "raw": raw}


class Unigram:
    """Encoder and decoder over a ``vocabulary``."""

    def __init__(self, vocab: dict):
        self.auto = ahocorasick.Automaton()
        for text, score, i in vocab["pieces"]:
            if SPACE in text.lstrip(SPACE) or "\n" in text:
                raise ValueError(f"piece {text!r} crosses a word's end")
            self.auto.add_word(text, (len(text), score, i))
        self.auto.make_automaton()
        self.single = {text for text, _, _ in vocab["pieces"] if len(text) == 1}
        self.joined = {text[i : i + 2] for text, _, _ in vocab["pieces"] for i in range(len(text) - 1)}
        self.longest = max(len(text) for text, _, _ in vocab["pieces"])
        self.unknown = min(s for _, s, _ in vocab["pieces"]) - 10.0
        self.byte, self.raw = vocab["byte"], vocab["raw"]

    def lattice(self, s: str, into: dict[int, float] | None = None):
        """(best, start, piece) by end position; ``into``: scores of the positions at which a path may begin."""
        n = len(s)
        best, start, piece = [-1e300] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        for i, x in (into or {0: 0.0}).items():
            best[i] = x
        single, unknown, done = self.single, self.unknown, 0
        for end, (size, score, i) in self.auto.iter(s):
            end += 1
            while done < end - 1:  # positions that no piece ended at
                done += 1
                if s[done - 1] not in single and best[done - 1] + unknown > best[done]:
                    best[done], start[done], piece[done] = best[done - 1] + unknown, done - 1, -1
            at = end - size
            x = best[at] + score
            if x > best[end] and best[at] > -1e299:
                best[end], start[end], piece[end] = x, at, i
            if size == 1:
                done = end
        # a last position, or one whose last character has pieces ending there but none of its own
        while done < n:
            done += 1
            if s[done - 1] not in single and best[done - 1] + unknown > best[done]:
                best[done], start[done], piece[done] = best[done - 1] + unknown, done - 1, -1
        return best, start, piece

    def back(self, s: str, start: list[int], piece: list[int], end: int) -> tuple[list[int], int]:
        """Ids of the path that ends at ``end``, and where it begins."""
        ids: list[int] = []
        while start[end] >= 0:
            at = start[end]
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                ids.extend(self.byte[b] for b in reversed(s[at:end].encode("utf-8", "surrogatepass")))
            end = at
        ids.reverse()
        return ids, end

    def word(self, s: str) -> tuple[float, list[int]]:
        best, start, piece = self.lattice(s)
        return best[-1], self.back(s, start, piece, len(s))[0]

    def count(self, s: str) -> int:
        """Count-only Viterbi: score and number of pieces are carried, no path is kept."""
        n = len(s)
        best, many = [-1e300] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        single, unknown, done = self.single, self.unknown, 0
        for end, (size, score, _) in self.auto.iter(s):
            end += 1
            while done < end - 1:
                done += 1
                if s[done - 1] not in single and (x := best[done - 1] + unknown) > best[done]:
                    best[done], many[done] = x, many[done - 1] + len(s[done - 1].encode("utf-8", "surrogatepass"))
            x = best[end - size] + score
            if x > best[end]:
                best[end], many[end] = x, many[end - size] + 1
            if size == 1:
                done = end
        while done < n:
            done += 1
            if s[done - 1] not in single and (x := best[done - 1] + unknown) > best[done]:
                best[done], many[done] = x, many[done - 1] + len(s[done - 1].encode("utf-8", "surrogatepass"))
        return many[n]

    def units(self, text: str) -> list[str]:
        """Parts that no piece crosses."""
        if "  " in text or SPACE in text or text[:1] == " ":
            return UNITS.findall(SPACE + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", f" {SPACE}").replace("\n", " \n ")).split(" ") if text else []

    def decode(self, ids) -> str:
        got = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return got[1:] if got[:1] == " " else got


class Counts(dict):
    """unit -> number of pieces, for up to ``most`` units."""

    def __init__(self, model: Unigram, most: int = 300_000):
        super().__init__()
        self.model, self.most, self.seen = model, most, bytearray(1 << 21)

    def of(self, units: list[str], often: np.ndarray) -> np.ndarray:
        """Those of different units that occur so often; one that occurs once is remembered when it comes again.

        A last character that no piece joins to the one before it (a full stop
        after a letter) is counted by itself.
        """
        made, seen, last, joined = list(map(self.get, units)), self.seen, len(self.seen) - 1, self.model.joined
        for i in [i for i, x in enumerate(made) if x is None]:
            unit, end, many = units[i], 0, None
            if len(unit) > 1 and unit[-2:] not in joined:
                unit, end = unit[:-1], self[unit[-1]]
                many = self.get(unit)
            if many is None:
                many, at = self.model.count(unit), hash(unit) & last
                if often[i] > 1 or seen[at]:
                    if len(self) >= self.most:
                        self.clear()
                        seen[:] = bytes(len(seen))
                    self[unit] = many
                seen[at] = 1
            made[i] = many + end
        return np.array(made, np.int64)

    def __missing__(self, unit: str) -> int:
        if len(self) >= self.most:
            self.clear()
        made = self[unit] = self.model.count(unit)
        return made


class Ids(dict):
    """unit -> its ids as int32 bytes, for up to ``most`` units."""

    def __init__(self, model: Unigram, most: int = 120_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        made = self[unit] = np.array(self.model.word(unit)[1], np.int32).tobytes()
        return made


_LOADED: dict = {}


def loaded(shared) -> tuple[Unigram, Counts, Ids]:
    """The worker's own encoder for a broadcast vocabulary."""
    key = shared.value["pieces"][-1], len(shared.value["pieces"])
    if key not in _LOADED:
        model = Unigram(shared.value)
        _LOADED.clear()
        _LOADED[key] = model, Counts(model), Ids(model)
    return _LOADED[key]
