"""Licence scans by canonical digest: a whole text, brought to one spelling, is looked up among known licences' digests.

Runs of whole lines inside longer texts are looked up the same way, so that a notice of one line or a licence of many is
found between other text. Which texts and runs are worth a digest follows from the known texts alone: a text must hold one
of their anchor words, a run begin with the first words of one and be as long.

Defined cases: null text is empty text; it matches nothing. One row comes out for each that goes in, repeated rows and rows
without doc_id among them; an empty table gives none. A text counts whole, however long. Columns but doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

#: Spellings that licence matching treats as one, old and new, as words of the canonical text.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("per cent", "percent"),
)
_SINGLE = {old: new for old, new in SPELLINGS if " " not in old}
_PAIRS = {tuple(old.split()): new for old, new in SPELLINGS if " " in old}
#: The lines that oracle()'s SQL takes for statements of copyright; and what separates the words of a canonical text.
COPYRIGHT_LINE = r"(?:^|\n)[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"
#: Words that go on after "copyright", or after "(c)" as an item of a list, where a licence's own words were wrapped there.
GOES_ON = {
    "copyright": "also and are as by disclaimers? doctrines? does file for grants? holders? if in information infringements? interests? is law laws legends? licen[cs]e[ds]? like lines? management marks? may must notices? of on or owners? ownership page patents? permissions? protection registration resulting rights? shall statements? status terms that this those to treat(?:y|ies) under which will with".split(),
    "(c)": "a all an and any are as at by each for from if in is it its no on or representations such that this to under where which with you your".split(),
}
#: Whoever "copyright the ..." and "(c) the ..." name, if it is a statement.
HOLDERS = "authors?|contributors?|developers?|maintainers?|committers|project|team|foundation|regents|university|institute|company|corporation|inc|ltd|llc|group|association|consortium|community"


def statement(word: str, other: str) -> str:
    """A lower-case line that only states a copyright: the sign, or (c) or the word with a year or a holder; word and other are patterns of one character."""
    end = f"(?!{word})"
    copyright, item = (rf"(?!(?:the|{'|'.join(x)}){end})" for x in GOES_ON.values())
    the = rf"the{end}[^\n]*(?<!{word})(?:{HOLDERS}){end}"
    return rf"(?:^|\n){other}*(?:©|all rights reserved|copyrights?{end}{other}*(?:\(c\)|©|{copyright}{word}|{the})|\(c\){other}*(?:©|{item}{word}|{the}))[^\n]*"


_STATEMENT, _STATEMENT_RE = statement(r"[\p{L}\p{N}]", r"[^\p{L}\p{N}\n]"), re.compile(statement(r"[^\W_]", r"(?:_|[^\w\n])"))
#: Only texts that hold one of these go through the replacement of spellings, which leaves all others as they are.
_ANY_SPELLING = f"(?:^| )(?:{'|'.join(old for old, _ in SPELLINGS)})(?: |$)"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, words joined by one space, one spelling each; null is empty."""
    return canonical_of_lower(F.lower(F.coalesce(text, F.lit(""))))


def canonical_of_lower(x: Column) -> Column:
    x = F.when(F.contains(x, F.lit("copyright")) | F.contains(x, F.lit("(c)")) | F.contains(x, F.lit("©")) | F.contains(x, F.lit("all rights reserved")), F.regexp_replace(x, _STATEMENT, "")).otherwise(x)
    return F.trim(F.regexp_replace(x, BETWEEN_WORDS, " "))


def one_spelling(words: Column) -> Column:
    spelled = F.concat(F.lit(" "), F.regexp_replace(words, " ", "  "), F.lit(" "))
    for old, new in SPELLINGS:
        spelled = F.regexp_replace(spelled, f" {old.replace(' ', '  ')} ", f" {new.replace(' ', '  ')} ")
    spelled = F.trim(F.regexp_replace(spelled, "  ", " "))
    return F.when(words.rlike(_ANY_SPELLING), spelled).otherwise(words)


#: Short licence texts and notices in full. Longer ones come in through `known`, a parameter of every call; licence_texts.common() has them.
KNOWN = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
}


def canonical_text(text: str) -> str:
    """The same as canonical() and one_spelling() on the driver, for known texts."""
    x = _STATEMENT_RE.sub("", text.lower())
    x = f"  {'  '.join(re.findall(r'[^\W_]+', x))}  "
    for old, new in SPELLINGS:
        x = x.replace(f" {old.replace(' ', '  ')} ", f" {new.replace(' ', '  ')} ")
    return x.strip().replace("  ", " ")


def digests(known: Mapping[str, str | tuple[str, ...]]) -> dict[str, str]:
    """Canonical SHA-256 -> licence, of each of its forms; equal canonical texts keep the first name in order."""
    out: dict[str, str] = {}
    for name in sorted(known):
        for text in [known[name]] if isinstance(known[name], str) else known[name]:
            out.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), name)
    return out


def tokens_by_line(text: str) -> tuple[list[str], list[int]]:
    """The words of a text's canonical form, and where lines with a word begin among them. A word made of two belongs to the first one's line."""
    words: list[str] = []
    starts: list[int] = []
    for line in _STATEMENT_RE.sub("", text.lower()).split("\n"):
        found = [y for x in re.findall(r"[^\W_]+", line) for y in _SINGLE.get(x, x).split()]
        if not found:
            continue
        starts.append(len(words))
        for w in found:
            if words and (pair := _PAIRS.get((words[-1], w))):
                words[-1] = pair
                if starts[-1] == len(words):
                    starts.pop()  # the line's first word went to the line before; its next one begins it
                    starts.append(len(words))
            else:
                words.append(w)
        if starts[-1] >= len(words):
            starts.pop()
    return words, sorted(set(starts))


#: Digests of known texts up to which they are broadcast: some 10 MB.
BROADCAST_MOST = 100_000


class Runs:
    """Known canonical texts by their first words and length in words."""

    FIRST = 3

    def __init__(self, known: Mapping[str, str | tuple[str, ...]]):
        self.names = digests(known)
        self.lengths: dict[tuple[str, ...], set[int]] = {}
        texts = []
        for text in {canonical_text(t) for x in known.values() for t in ([x] if isinstance(x, str) else x)}:
            if words := text.split(" ") if text else []:
                self.lengths.setdefault(tuple(words[: self.FIRST]), set()).add(len(words))
                texts.append(set(words))
        self.anchors = self._anchors(texts)

    @staticmethod
    def _anchors(texts: list[set[str]]) -> list[str]:
        """Strings of which each text that is one of the known ones holds at least one, in lower case: few, and of long words.

        A word that another spelling leads to is no anchor; where a text has no other words, all spellings of one are.
        """
        made, out = {y for _, new in SPELLINGS for y in new.split()}, set()
        while texts:
            count = Counter(w for t in texts for w in t if w not in made)
            if not count:
                word = min(min(t) for t in texts)
                out |= {o.split()[0] for o, n in SPELLINGS if word in n.split()} | {word}
                texts = [t for t in texts if word not in t]
                continue
            best = max(count, key=lambda w: (min(len(w), 6), count[w], w))
            out.add(best)
            texts = [t for t in texts if best not in t]
        return sorted(out)

    def found(self, text: str | None) -> list[str]:
        """Names of the known texts that are runs of whole lines of text, sorted, each once."""
        if not text:
            return []
        words, starts = tokens_by_line(text)
        ends, out = {*starts[1:], len(words)}, set()
        for s in starts:
            for n in range(1, self.FIRST + 1):
                for length in self.lengths.get(tuple(words[s : s + n]), ()):
                    if s + length in ends and (n == self.FIRST or length == n):
                        name = self.names.get(hashlib.sha256(" ".join(words[s : s + length]).encode()).hexdigest())
                        out |= {name} if name else set()
        return sorted(out)


def scan(docs: DataFrame, known: Mapping[str, str | tuple[str, ...]] = KNOWN, *, lines: bool = True) -> DataFrame:
    """doc_id, digest (of the whole canonical text), licence (null if unknown), and the known texts among its runs of lines.

    One row a row of docs (doc_id, text). The join is on the digest of entire texts; the known table is broadcast up to
    BROADCAST_MOST digests, and joined as Spark will beyond. With lines, `notices` lists what runs of lines are, sorted, each once.
    """
    spark: SparkSession = docs.sparkSession
    text = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    runs = Runs(known)
    found = spark.createDataFrame(list(runs.names.items()), "digest string, licence string")
    digest = F.sha2(one_spelling(canonical_of_lower(F.col("low"))), 256)
    if lines and runs.names:
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("notices", pa.list_(pa.string()))])

        def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, n in _shared.slices(b.column(2)):
                    part = b.slice(at, n)
                    yield pa.record_batch([part.column(0), part.column(1), pa.array([runs.found(t) for t in part.column(2).to_pylist()], pa.list_(pa.string()))], schema=schema)

        held = reduce(Column.__or__, [F.contains("low", F.lit(a)) for a in runs.anchors])
        worth = F.when(held, F.col("text"))  # only these texts leave the JVM
        out = _shared.arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), worth.alias("text")), look, "doc_id long, digest string, notices array<string>")
    else:
        out = rows.select("doc_id", digest.alias("digest"), F.array().cast("array<string>").alias("notices"))
    if len(runs.names) <= BROADCAST_MOST:
        found = F.broadcast(found)
    return out.join(found, "digest", "left").select("doc_id", "digest", "licence", "notices")


def oracle(known: Mapping[str, str] = KNOWN) -> str:
    """DuckDB SQL for scan(documents, known) with notices joined by commas."""
    values = ", ".join(f"('{d}', '{n}')" for d, n in digests(known).items())
    marks = " OR ".join(f"contains(x, '{w}')" for w in ("copyright", "(c)", "©", "all rights reserved"))
    spelled = "' ' || replace(x, ' ', '  ') || ' '"
    for old, new in SPELLINGS:
        spelled = f"replace({spelled}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"""
        WITH known(digest, licence) AS (VALUES {values}),
        units AS (SELECT doc_id, -1 AS line, coalesce(text, '') AS x FROM documents
                  UNION ALL SELECT doc_id, i, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
                  WHERE regexp_matches(x, '(?i)licen[cs]|released|permission|granted')),
        low AS (SELECT doc_id, line, lower(x) AS x FROM units),
        bare AS (SELECT doc_id, line, CASE WHEN {marks} THEN regexp_replace(x, '{COPYRIGHT_LINE}', '', 'g') ELSE x END AS x FROM low),
        words AS (SELECT doc_id, line, trim(regexp_replace(x, '{BETWEEN_WORDS}', ' ', 'g')) AS x FROM bare),
        hashed AS (SELECT doc_id, line, sha256(trim(replace({spelled}, '  ', ' '))) AS digest FROM words),
        found AS (SELECT doc_id, line, digest, licence FROM hashed LEFT JOIN known USING (digest))
        SELECT doc_id, max(digest) FILTER (line = -1) AS digest, max(licence) FILTER (line = -1) AS licence,
               coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (line >= 0), '') AS notices
        FROM found GROUP BY doc_id"""
