"""License scans: canonical digests of entire texts, hash-joined to known licences. DataFrame functions only.

Canonical form: A-Z lower-cased, http as https, equivalent spellings made one (licence, sub-licence, organisation, favour, "&", typographic quotes
and dashes), list marks and every sign other than letters and digits made a blank, statements of copyright and the words "all rights reserved"
taken out, blanks collapsed and cut off. A statement ends before the first words known to
follow one (OPENERS) if they come in its paragraph, on whichever line, or begin the next; one within a line at the near end of its paragraph; any
other with its line. So words between a holder and such words are taken for the holder's name. The SHA-256 of that form is looked up in the digests of the known texts.

The whole text of a document is looked up, and so is each of its lines on its own, as a notice is a known text that stands alone on a line. Lines
whose canonical form is longer than the longest known one-line notice are no candidates, so only few lines meet the join. A document gets
the licence of its whole text, and the sorted distinct licences of its lines.

Defined results: a null text has a null digest and no licence; an empty text, or one that is only signs and copyright lines, has the digest
of the empty form, which is no licence; repeated rows are looked up each; other columns are ignored.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read



def _forms(name: str, text: str) -> list[tuple[str, str]]:
    """(licence, text) for the ways in which a full text is found: lines as published or one a paragraph; with or without its title, the numbers
    of its clauses, and what follows its end."""
    text = text.strip("\n")
    bodies = [text, re.split(r"\n *END OF TERMS AND CONDITIONS", text)[0], re.split(r"\n *Creative Commons is not a party", text)[0]]
    bodies += [f"{b}\n\nEND OF TERMS AND CONDITIONS" for b in bodies[1:2] if b != text]
    if name in TITLES:
        untitled = text.split("\n", 1)[1].strip("\n")
        bodies += [untitled, *[f"{t}\n\n{untitled}" for t in TITLES[name]]]
    if name.startswith("BSD"):
        bodies += [re.sub(r"(?m)^\d\. ", "", b) for b in bodies]
    bodies += ["\n".join(" ".join(x.split()) for x in re.split(r"\n\s*\n", b)) for b in bodies]
    return [(name, b) for b in dict.fromkeys(bodies)]


#: Titles of texts that are also found without one, besides that of the file.
TITLES = {"MIT": ["The MIT License (MIT)", "The MIT License"], "BSD-2-Clause": ["The 2-Clause BSD License"], "BSD-3-Clause": ["The 3-Clause BSD License"]}
#: Full texts and standard headers: a file of license_texts each, named after its licence.
FULL = [x for f in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt") for x in _forms(f.name.removesuffix(".txt").removesuffix(".header"), f.read_text(encoding="utf-8"))]
#: Known texts: (licence, text). Public licence texts and notices.
KNOWN = [
    *FULL,
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
]
#: (found, made) in order, on lower-cased text. Fixed values.
SPELLINGS = [
    ("licence", "license"),
    ("sub-licens", "sublicens"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("neighbour", "neighbor"),
    ("merchantibility", "merchantability"),
    ("http://", "https://"),
    ("&", " and "),
    ("©", " copyright (c) "),
]
SIGNS = r"[^\p{L}\p{N}\n]+"
#: The sign that stands for a break between paragraphs while statements are sought (no other sign is left then).
PARAGRAPH = "|"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How a statement of copyright begins, in canonical lines: the word before a sign, a year, a place for one, or "by"; or the sign before a year or "by".
STATES = r"(?:copyright[ \n])*(?:copyright[ \n](?:c[ \n]|[0-9]{4}|yyyy|year[ \n]|by[ \n])|c[ \n](?:[0-9]{4}|by[ \n]))"
#: What follows a statement in the known texts, besides their own beginnings. Fixed values.
OPENERS = [
    "everyone is permitted", "permission is hereby granted", "permission is granted", "permission to use", "redistribution and use", "licensed under", "released under", "this program is free", "this library is free",
    "this is free software", "this work is licensed", "to the extent possible", "the contents of this", "this source code form", "gnomovision version", "the precise terms", "preamble",
]
#: A statement that goes before one of these in its paragraph or at the beginning of the next, wherever lines break: at most so many signs, so that the sentence after it is kept whole.
STATEMENT_SIGNS = 200
STATEMENT = rf"(^|[ \n|]){STATES}[^|]{{0,{STATEMENT_SIGNS}}}?([ \n]|\n\|)({'|'.join(o.replace(' ', '[ \n]') for o in OPENERS)})"
#: A statement within a line that ends its paragraph with a short name, on this line or the next.
STATEMENT_END = rf" {STATES}[^|]{{0,60}}?(\n\|)"
#: Any other line that begins as a statement, and a reservation anywhere.
STATEMENT_LINE = rf"(^|\n)[ |]*{STATES}[^\n]*"
RESERVED = r"(^|[ \n|])all[ \n]rights[ \n]reserved([ \n]|\z)"
#: (found, made) in order; $k is group k.
STEPS = [(SIGNS, " "), (r" ?\n ?", "\n"), (r"\n\n+", f"\n{PARAGRAPH}"), (STATEMENT, "$1$2$3"), (STATEMENT_END, "$1"), (STATEMENT_LINE, "$1"), (RESERVED, "$1$2")]
#: Up to so many known texts are broadcast: 150 bytes each.
BROADCAST_TEXTS = 100_000


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks. A statement of copyright ends where the sentence after it begins, on whichever line, so that new line breaks change nothing else."""
    x = F.translate(text, UPPER, LOWER)
    for found, made in SPELLINGS:
        x = F.replace(x, F.lit(found), F.lit(made))
    for found, made in STEPS:
        x = F.regexp_replace(x, found, made)
    return F.replace(x, F.lit(PARAGRAPH), F.lit(" "))


def canonical(lines: Column) -> Column:
    """The canonical form of a text from its canonical lines."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """known_digest, license, n: the length of the canonical form if the text is one line, else null."""
    base = spark.createDataFrame(texts, "license string, known_text string").withColumn("form", canonical(canonical_lines(F.col("known_text"))))
    rows = base.select("license", digest(F.col("form")).alias("known_digest"), F.when(F.instr("known_text", "\n") == 0, F.length("form")).alias("n"))
    return rows.groupBy("known_digest").agg(F.min("license").alias("license"), F.max("n").alias("n"))


def scanned(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """doc_id, text_digest, license (of the entire text), line_licenses (sorted, joined by ", ") of every row of docs."""
    count, lengths = listed.agg(F.count("*"), F.array_sort(F.collect_set("n"))).first()
    lines = canonical_lines(F.col("text"))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), lines.alias("lines"))
    short = F.transform(F.split("lines", "\n"), lambda t: F.trim(t))
    # equal digests need equal lengths: other lines cannot match
    short = F.array_distinct(F.filter(short, lambda t: F.length(t).isin(lengths or [-1])))
    rows = rows.select("doc_id", "row", digest(canonical(F.col("lines"))).alias("text_digest"), F.transform(short, lambda t: digest(t)).alias("line_digests"))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.col("text_digest").alias("digest")))
    each = F.transform("line_digests", lambda d: F.struct(F.lit(False).alias("whole"), d.alias("digest")))
    asked = rows.select("doc_id", "row", "text_digest", F.inline(F.concat(whole, F.coalesce(each, F.array().cast("array<struct<whole:boolean,digest:string>>")))))
    small = F.broadcast(listed) if count <= BROADCAST_TEXTS else listed
    hits = asked.join(small, (F.col("digest") == F.col("known_digest")) & (F.col("whole") | F.col("n").isNotNull()), "left")
    out = hits.groupBy("row", "doc_id", "text_digest").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ", ").alias("line_licenses"),
    )
    return out.select("doc_id", "text_digest", "license", "line_licenses")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents"), known(spark))


def _sql(text: str) -> str:
    x = f"translate({text}, '{UPPER}', '{LOWER}')"
    for found, made in SPELLINGS:
        x = f"replace({x}, '{found}', '{made}')"
    for found, made in STEPS:
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, found, made.replace("$", "\\"))
    return f"replace({x}, '{PARAGRAPH}', ' ')"


_FORM = "trim(regexp_replace({0}, '[ \\n]+', ' ', 'g'))"
_TEXTS = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
ORACLE = f"""
WITH k0(license, t) AS (VALUES {_TEXTS}),
k AS (SELECT sha256({_FORM.format(_sql("t"))}) AS digest, min(license) AS license, max(CASE WHEN contains(t, chr(10)) THEN NULL ELSE 1 END) AS line FROM k0 GROUP BY 1),
d AS (SELECT row_number() OVER () AS i, doc_id, {_sql("text")} AS lines FROM documents),
w AS (SELECT i, doc_id, sha256({_FORM.format("lines")}) AS text_digest FROM d),
l AS (SELECT DISTINCT i, license FROM (SELECT i, sha256(trim(unnest(string_split(lines, chr(10))))) AS digest FROM d) JOIN k USING (digest) WHERE line = 1),
s AS (SELECT i, string_agg(license, ', ' ORDER BY license) AS line_licenses FROM l GROUP BY i)
SELECT doc_id, text_digest, k.license, coalesce(line_licenses, '') AS line_licenses FROM w LEFT JOIN k ON text_digest = digest LEFT JOIN s USING (i)"""
