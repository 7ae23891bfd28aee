"""Marks, sentences and capitals of texts as Arrow columns: what a word holds is counted once for the distinct words of a batch, then
summed by text; no pattern is searched over a whole text.  Words are what stands between ASCII white space."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from chorale import words as W
from chorale.functions.text import NOT_WORD, WORD, as_col, phrase_pattern

LITERALS = {"dots": ".", "asks": "?", "shouts": "!", "commas": ",", "opened": "(", "closed": ")", "opened_square": "[", "closed_square": "]",
            "double": '"', "single": "'"}
INSIDE = [f"[.!?]{WORD}", r",[^\s]", r"[.!?]{2,}"]
PATTERNS = {"proper": W.CONTRACTED, "apostrophes": f"{WORD}+'{WORD}+", "hard_quotes": '"[.!?,]'}
PHRASES = {"questions": W.QUESTION_WORDS, "abbr": W.ABBREVIATIONS}
PHRASE = f"(?i)(?:^|{NOT_WORD})(?:{'|'.join(W.QUESTION_WORDS + W.ABBREVIATIONS)})(?:{NOT_WORD}|$)|İ"  # İ becomes two characters when lowered
COUNTS = ["n", "sentences", "sentence_words", "capitals", "long_runs", "lists", "listed", "questions", "abbr", "dotted", "errors", "inner", "named",
          "runs", "titled", "caps", "wrong", "acronyms", "fine", "loose", *LITERALS, *PATTERNS]
BATCH = 8 << 20  # bytes of text worked on at once


def _count(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False)


def _holds(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)


def _in(words: pa.Array, listed: list[str]) -> np.ndarray:
    return pc.is_in(words, value_set=pa.array(listed)).to_numpy(zero_copy_only=False)


def _lowered(words: pa.Array) -> pa.Array:
    return pa.array([w.lower() for w in words.to_pylist()], pa.string())


def word_facts(words: pa.Array) -> dict[str, np.ndarray]:
    """Counts and tests of each word by itself; what only few words can hold is looked for in those."""
    f = {"loose": _count(words, W.UNCONTRACTED), "content": ~_in(words, W.TITLE_FUNCTION), "and": _in(words, ["and"])}

    def put(at: np.ndarray, **values: np.ndarray) -> None:
        for name, found in values.items():
            f.setdefault(name, np.zeros(len(words), found.dtype))[at] = found

    at = np.flatnonzero(_holds(words, r"\p{Lu}"))
    some = words.take(pa.array(at))
    bare = pc.replace_substring_regex(some, NOT_WORD, "")
    low, size, cap, cap_bare = _lowered(bare), pc.utf8_length(bare).to_numpy(zero_copy_only=False), _holds(some, r"^\p{Lu}"), _holds(bare, r"^\p{Lu}")
    upper = (size >= 2) & (size <= 6) & np.array([w == w.upper() for w in bare.to_pylist()], bool)
    put(at, cap=cap, cap_bare=cap_bare, name=cap_bare & (size > 1), known_name=_holds(low, W.PLACE_NAMES) | ~_in(low, W.COMMON_LOWER),
        small=cap & _in(low, W.LOWER_CASE_WORDS), cap_piece=_holds(some, r"^[.!?]*\p{Lu}"), cap_pieces=cap.astype(np.int32), acronyms=upper,
        fine=upper & (_in(bare, W.ACRONYMS) | (size == 2) | ~_holds(bare, "^([AEIOU]+|[BCDFGHJKLMNPQRSTVWXYZ]+)$")))

    at = np.flatnonzero(_holds(words, PHRASE))
    low = _lowered(words.take(pa.array(at)))
    spaced = pc.binary_join_element_wise("", pc.replace_substring_regex(low, f"({NOT_WORD})", r"\1\1"), "", " ")
    put(at, **{name: _count(spaced, phrase_pattern(x)) for name, x in PHRASES.items()},
        dotted=_count(pc.binary_join_element_wise("", low, " "), f"{NOT_WORD}(?:{'|'.join(W.ABBREVIATIONS)})\\.{WORD}"))

    at = np.flatnonzero(_holds(words, r"""[.?!,;:()\[\]"']"""))
    some = words.take(pa.array(at))
    put(at, **{name: pc.count_substring(some, mark).to_numpy(zero_copy_only=False) for name, mark in LITERALS.items()})
    f["stop"] = f["dots"] + f["asks"] + f["shouts"] > 0
    f["stop_last"], f["pieces"] = f["stop"].copy(), np.ones(len(words), np.int32)  # of a word with one mark, at its end
    at = at[~_holds(some, f"^{WORD}+[.?!,;:]$")]
    some = words.take(pa.array(at))
    put(at, **{name: _count(some, pattern) for name, pattern in PATTERNS.items()}, inside=sum(_count(some, pattern) for pattern in INSIDE),
        mark_first=_holds(some, "^[.!?,;:]"), stop_first=_holds(some, "^[.!?]"), stop_last=_holds(some, "[.!?]$"), pieces=_count(some, "[^.!?]+"),
        cap_pieces=_count(pc.binary_join_element_wise("", some, "."), r"[.!?]\p{Lu}"))
    return f


def _apart(starts: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Matches of four words that do not overlap, from the left; the last word may open the next match if ``again`` tells that enough of it is left."""
    taken, last = [], -4
    for at, rest in zip(starts.tolist(), again.tolist()):
        if at > last + 3 or (at == last + 3 and rest):
            taken.append(at)
            last = at
    return np.array(taken, np.int64)


def _marks(texts: pa.Array) -> dict[str, np.ndarray]:
    split = pc.ascii_split_whitespace(texts)
    full = pc.binary_length(split.values).to_numpy(zero_copy_only=False) > 0
    edges = split.offsets.to_numpy()
    kept = np.concatenate([[0], np.cumsum(full)])
    begin, end, docs = kept[edges[:-1]], kept[edges[1:]], len(texts)
    some = end > begin
    coded = pc.dictionary_encode(split.values.filter(pa.array(full)))
    code, facts = coded.indices.to_numpy(), word_facts(coded.dictionary)
    total, doc = len(code), np.repeat(np.arange(docs), end - begin)

    def of(name: str) -> np.ndarray:
        return facts[name][code]

    def by_text(x: np.ndarray) -> np.ndarray:
        out = np.zeros(docs, np.int64)
        if total:
            out[some] = np.add.reduceat(x, begin[some], dtype=np.int64)
        return out

    first = np.zeros(total, bool)
    first[begin[some]] = True

    def after(x: np.ndarray) -> np.ndarray:
        return first | np.concatenate([[False], x[:-1]])[:total]

    out = {"n": np.maximum(end - begin, 1)}  # an empty text is one empty word
    out |= {name: by_text(of(name)) for name in (*LITERALS, *PATTERNS, *PHRASES, "loose", "dotted", "acronyms", "fine")}
    out["caps"], out["sentence_words"] = by_text(of("cap")), by_text(of("pieces"))

    opens = after(of("stop_last")) | of("stop_first")  # the word's first piece opens a sentence; its other pieces always do
    pieces = of("pieces")
    out["sentences"] = by_text(np.where(pieces > 0, pieces - 1 + opens, 0))
    out["capitals"] = by_text(of("cap_pieces") - (of("cap_piece") & ~opens))
    spaced = np.ones(total, bool)
    spaced[begin[some]] = ~full[edges[:-1][some]]  # only a text that begins with white space has some before its first word
    out["errors"] = by_text(of("inside") + (of("mark_first") & spaced))

    start, name = after(of("stop")), of("name")
    out["inner"], out["named"] = by_text(name & ~start), by_text(name & ~start & of("known_name"))
    out["wrong"] = by_text(of("small") & ~start)

    slot, slots = np.arange(total) + doc, np.repeat(np.arange(docs), end - begin + 1)  # one slot a word and one that closes the text

    def gaps(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        closing = np.ones(total + docs, bool)
        closing[slot] = flag
        at = np.flatnonzero(closing)
        return at, np.diff(at, prepend=-1) - 1

    at, length = gaps(of("stop"))
    out["long_runs"] = np.bincount(slots[at], np.maximum(length - 30, 0), docs).astype(np.int64)
    at, length = gaps(~of("cap_bare"))
    at, length = at[length >= 2], length[length >= 2]
    content = np.zeros(total + docs, np.int64)
    content[slot] = of("content")
    content = np.concatenate([[0], np.cumsum(content)])
    out["runs"] = np.bincount(slots[at], minlength=docs)
    out["titled"] = np.bincount(slots[at[(length <= 6) & (content[at] > content[at - length])]], minlength=docs)

    opening = np.flatnonzero(of("and")) - 2  # first of the four words "A B and D", or "A, B and D"
    opening = opening[(opening >= 0) & (opening + 3 < total)]
    opening = opening[doc[opening] == doc[opening + 3]]
    words = [coded.dictionary.take(pa.array(code[opening + i])) for i in (0, 1, 3)]
    fits = _holds(words[1], f"^{WORD}+$") & _holds(words[2], f"^{WORD}")
    for column, mark in (("lists", ""), ("listed", ",")):
        kept = fits & _holds(words[0], f"{WORD}{mark}$")
        again = _holds(words[0], f"^{WORD}+{NOT_WORD}.*{WORD}{mark}$")
        out[column] = np.bincount(doc[_apart(opening[kept], again[kept])], minlength=docs)
    return out


def _batch(texts: pa.Array) -> pa.Array:
    """The counts of a batch, worked out some megabytes of text at a time."""
    texts = texts.cast(pa.string())
    reached = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(reached // BATCH, prepend=0)).tolist() if len(texts) else []
    parts = [_marks(texts[a:b]) for a, b in zip([0, *cuts], [*cuts, len(texts)]) if b > a]
    if not parts:
        return pa.StructArray.from_arrays([pa.array([], pa.int32())] * len(COUNTS), COUNTS)
    missing = texts.is_null().to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]), pa.int32(), mask=missing) for c in COUNTS], COUNTS)


def marks_of(text: Column | str) -> Column:
    """The counts of ``COUNTS``, each null for a null text."""
    return F.arrow_udf(_batch, f"struct<{', '.join(f'{c}:int' for c in COUNTS)}>")(as_col(text))
