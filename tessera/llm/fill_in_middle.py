"""Fill-in-middle transformation by lookaround splitting.

A grammar says of which units a text is made, left to right: single characters of a class, or runs of a
class, which a run of another class may follow (a word and its blanks). It is translated to a regular
expression of no width that matches between two neighbouring characters wherever one unit ends and
another begins; ``split`` by it cuts a text into its units and loses nothing. An empty text has no unit,
where ``split`` gives one empty piece, and is left as it is.

How a document is cut and written hangs on a hash of its id alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, utf8

#: The marks of the parts, the share of documents left plain and of those written suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
SALT = "1:"


@dataclass(frozen=True)
class One:
    """Each character of the class (what stands between [ and ] of a regular expression) is a unit."""

    of: str


@dataclass(frozen=True)
class Run:
    """A run of characters of the class is a unit, with the run of ``then`` that follows it."""

    of: str
    then: str = ""


_SPACE, _LETTER, _DIGIT = r"\x20\x09-\x0D", r"\p{L}\p{M}", r"\p{Nd}"
#: Grammars by name; the classes of a grammar's heads (``of``) are disjoint and, with ``then``, hold all characters.
GRAMMARS: dict[str, tuple[One | Run, ...]] = {
    "characters": (One(r"\x{0}-\x{10FFFF}"),),
    "words": (Run(f"^{_SPACE}", _SPACE), Run(_SPACE)),
    "lines": (Run(r"^\n", r"\n"), Run(r"\n")),
    "tokens": (Run(_LETTER, _SPACE), Run(_DIGIT, _SPACE), Run(_SPACE), One(f"^{_LETTER}{_DIGIT}{_SPACE}")),
}


def boundary(grammar: tuple[One | Run, ...]) -> str:
    """The places between two characters where a unit of the grammar ends.

    After a single unit: any. After a run: where a character follows that is neither of its class nor of what
    may follow it. Within what follows a run: where another class begins.
    """
    everything = r"[\x{0}-\x{10FFFF}]"
    inside = lambda c: c if c.startswith("^") else f"[{c}]"
    places = []
    for unit in grammar:
        if isinstance(unit, One):
            places.append(f"(?<=[{unit.of}])(?={everything})")
            continue
        own = f"[{unit.of}]"
        if unit.then:
            places.append(f"(?<={own})(?!{own}|[{unit.then}])(?={everything})")
            places.append(f"(?<=[{unit.then}])(?=[^{inside(unit.then)}])")
        else:
            places.append(f"(?<={own})(?!{own})(?={everything})")
    return "|".join(places)


def units(text: Column, grammar: str = "characters") -> Column:
    """The units of a text in order; joined they are the text. A null or empty text has none."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, boundary(GRAMMARS[grammar]), -1))


def draws(doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers that hang on the id alone; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(SALT), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, grammar: str = "characters") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output, text of each row.

    Null texts are empty; empty texts and texts that hold one of the marks stay plain. Equal rows give equal
    rows; an empty table gives none. Each text is cut once, its pieces being joined to three parts in the same row.
    """
    text = utf8()
    h1, h2, h3, h4 = draws(F.col("doc_id"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    form = F.when((text == "") | marked | (h3 % 100 >= PLAIN_FROM), "plain").when(h4 % 100 < SUFFIX_FIRST_BELOW, "spm").otherwise("psm")

    def parts(pieces: Column) -> Column:
        n = F.size(pieces).cast("long")
        a, b = F.least(h1 % (n + 1), h2 % (n + 1)).cast("int"), F.greatest(h1 % (n + 1), h2 % (n + 1)).cast("int")
        piece = lambda start, length: F.array_join(F.slice(pieces, start + 1, length), "")
        return F.struct(n.alias("n"), piece(F.lit(0), a).alias("prefix"), piece(a, b - a).alias("middle"), piece(b, n.cast("int") - b).alias("suffix"))

    # a lambda's argument is worked out once: the pieces of a text are never made again for one of its parts
    p = F.col("_p")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), form.alias("form"), F.get(F.transform(F.array(units(F.col("text"), grammar)), parts), F.lit(0)).alias("_p"))
    own = F.col("form")
    output = (
        F.when(own == "psm", F.concat(F.lit(PREFIX), p["prefix"], F.lit(SUFFIX), p["suffix"], F.lit(MIDDLE), p["middle"]))
        .when(own == "spm", F.concat(F.lit(SUFFIX), p["suffix"], F.lit(PREFIX), p["prefix"], F.lit(MIDDLE), p["middle"]))
        .otherwise(F.col("text"))
    )
    length = lambda c: F.when(own != "plain", F.char_length(c).cast("long"))
    return cut.select("doc_id", p["n"].alias("n"), "form", length(p["prefix"]).alias("prefix_chars"), length(p["middle"]).alias("middle_chars"), output.alias("output"), "text")


def restore(output: Column, form: Column) -> Column:
    """The text of an output: its parts stand between the marks, none of which a transformed text holds."""
    parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda p, k: F.get(p, F.lit(k))
    joined = lambda p: F.when(form == "psm", F.concat(at(p, 0), at(p, 2), at(p, 1))).otherwise(F.concat(at(p, 1), at(p, 2), at(p, 0)))
    return F.when(form == "plain", output).otherwise(F.get(F.transform(F.array(parts), joined), F.lit(0)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transformation of every document, and what its output is restored to."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_FILL_IN_MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT *, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1, n - b) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
