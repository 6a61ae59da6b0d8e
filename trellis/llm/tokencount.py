"""Token counts of whole texts: lengths of frequent pre-tokens are broadcast, misses are encoded in the worker."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

LIMIT = 2048
#: Documents that the table of frequent pre-tokens is fitted on (about), pre-tokens it holds at most, and
#: characters of each: at most 5 MB are broadcast.
SAMPLE = 10_000
FREQUENT = 1 << 16
LONGEST = 40
#: Pre-tokens that one task of the fit counts at once; beyond that it keeps the more frequent half.
COUNTED = 1 << 18
#: Misses of each kind that a worker keeps.
CACHED = 1 << 18
#: Characters of a text that are cut into pre-tokens at once.
WINDOW = 1 << 20

#: Between runs of other characters; the tokenizer drops it, and nothing that it does looks across it.
_GAP = regex.compile(r"[ \t\n\r\v\f]+")
_SOLID = regex.compile(r"[^ \t\n\r\v\f]+")
_ODD = regex.compile(r"[^ -~\t\n\r\v\f]")


class Tokenizer:
    """A tokenizer file of the ``tokenizers`` library, seen as pre-tokens and the number of ids of each.

    The number of ids of a text is the sum over its pre-tokens, as the model encodes each by itself.
    Where the file says that white space is dropped and the rest split by a pattern, plain ASCII runs
    are cut here by that pattern; all else goes through the library's own normaliser and pre-tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        if not path.endswith(".json"):
            raise ValueError("pre-tokens need a .json file of the tokenizers library")
        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.pattern = _split_pattern(spec)
        self.local = self.pattern is not None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or _GAP.search(t["content"]) for t in spec["added_tokens"])

    def size(self, pre_token: str) -> int:
        return len(self.library.model.tokenize(pre_token))

    def _own(self, text: str) -> Iterator[str]:
        normal, cut = self.library.normalizer, self.library.pre_tokenizer
        text = normal.normalize_str(text) if normal else text
        return (w for w, _ in cut.pre_tokenize_str(text)) if cut else iter([text] if text else [])

    def pre_tokens(self, text: str) -> Iterator[tuple[bool, Iterable[str]]]:
        """Groups (True, pre-tokens) and (False, runs): runs of other characters than white space for ``of_run``,
        or the whole text where it can't be cut."""
        if not self.local:
            yield (False, [text]) if any(a in text for a in self.added) else (True, self._own(text))
            return
        for part in _windows(text):
            spelled = any(a in part for a in self.added)
            if spelled or not part.isascii() or _ODD.search(part):
                runs = _SOLID.findall(part)
                plain = [r for r in runs if r.isascii() and r.isprintable() and not (spelled and any(a in r for a in self.added))]
                if len(plain) < len(runs):
                    known = set(plain)
                    yield False, [r for r in runs if r not in known]
                part = " ".join(plain)
            low = part.lower()
            yield True, self.pattern.findall(low) if len(low) <= 2 * WINDOW else (m[0] for m in self.pattern.finditer(low))

    def of_run(self, run: str) -> Iterator[str] | int:
        """The pre-tokens of a run by the library's own rules, or its number of ids if an added token stands in it."""
        return len(self.library.encode(run, add_special_tokens=False).ids) if any(a in run for a in self.added) else self._own(run)


def _split_pattern(spec: dict):
    """The pattern of a file that puts letters in lower case, drops white space and splits the rest; None for
    any other."""
    normal = (spec["normalizer"] or {}).get("normalizers", [])
    cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cut] != ["Split", "ByteLevel"]:
        return None
    if normal[1]["pattern"] != {"Regex": "\\s+"} or normal[1]["content"] != " " or cut[1]["add_prefix_space"] or cut[1].get("use_regex", True):
        return None
    pattern = cut[0]["pattern"].get("Regex")
    if not pattern or (cut[0]["behavior"], cut[0]["invert"]) != ("Removed", True) or not pattern.endswith(r"|[^\s\p{L}\p{N}]+"):
        return None
    return regex.compile(pattern)


def _windows(text: str) -> Iterator[str]:
    """Parts of a text of about WINDOW characters, cut in white space only."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + WINDOW) if at + WINDOW < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class Kept(dict):
    """What a function gives for each text, worked out once and kept for a while: CACHED texts of LONGEST characters
    at most; when so many are kept, it starts anew."""

    def __init__(self, work: Callable[[str], int]):
        super().__init__()
        self.work, self.missed = work, 0

    def __missing__(self, text: str) -> int:
        n = self.work(text)
        self.missed += 1
        if len(text) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[text] = n
        return n


class Sizes(dict):
    """Ids of each pre-token: the frequent ones are the dict, others are encoded once and kept for a while, as are
    the numbers of runs that the library must cut."""

    def __init__(self, tokenizer: Tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.kept, self.runs = tokenizer, Kept(tokenizer.size), Kept(self._of_run)

    def __missing__(self, pre_token: str) -> int:
        return self.kept[pre_token]

    def _of_run(self, run: str) -> int:
        found = self.tokenizer.of_run(run)
        return found if isinstance(found, int) else sum(map(self.__getitem__, found))

    def count(self, text: str) -> int:
        return sum(sum(map((self if cut else self.runs).__getitem__, group)) for cut, group in self.tokenizer.pre_tokens(text))


def _words(cut: Tokenizer, runs: Iterable[str]) -> Iterator[str]:
    """Pre-tokens of runs without added tokens."""
    for run in runs:
        found = cut.of_run(run)
        if not isinstance(found, int):
            yield from found


def frequent(docs: DataFrame, tokenizer: str, *, text_col: str = "text", sample: int = SAMPLE, most: int = FREQUENT) -> dict[str, int]:
    """The most frequent pre-tokens of about ``sample`` documents and their numbers of ids. It holds ``most``
    entries of LONGEST characters at most, whatever the table; it saves work and can't change a count."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).where("text is not null")
    total = docs.count()
    if total > sample:
        texts = texts.sample(sample / total, 11)

    def run(batches):
        cut, found = Tokenizer(tokenizer), Counter()
        for batch in batches:
            for text in batch.column(0):
                for whole, group in cut.pre_tokens(text.as_py()):
                    found.update(w for w in (group if whole else _words(cut, group)) if len(w) <= LONGEST)
                if len(found) > COUNTED:
                    found = Counter(dict(found.most_common(COUNTED // 2)))
        top = found.most_common()
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["w", "n"])

    counts = texts.mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    cut = Tokenizer(tokenizer)
    return {r.w: cut.size(r.w) for r in counts.orderBy(F.desc("n"), "w").limit(most).select("w").collect()}


def count(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, sample: int = SAMPLE, most: int = FREQUENT) -> DataFrame:
    """The tokens of every whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the path of a .json file; ids are those of the library without begin and end, and
    strings of added tokens inside a text count as the library counts them. One pass over the texts, no
    shuffle: a row is counted where it is read. Null and empty texts have 0 bytes and tokens; null ids
    stay null; repeated rows are counted each; an empty table gives no rows; other columns, whatever
    their names, aren't read.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, tokenizer, text_col=text_col, sample=sample, most=most))

    def run(batches):
        sizes = Sizes(Tokenizer(tokenizer), known.value)
        for batch in batches:
            n = [sizes.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        release()

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
