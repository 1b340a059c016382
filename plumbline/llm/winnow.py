"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A window starts at each line that is not blank and is the shortest run of such lines with at least min_words words. Of each window
the line with the smallest hash is selected, the last of equal ones; windows next to each other mostly select the same line, so that
few positions are fingerprints, and a run of min_words words selects the same ones wherever it stands. Positions are joined on their
line's hash: only those whose line was selected elsewhere too go on, with the hashes of the windows that selected them. Equal windows
of such positions are matches; each is held against the first of all, extended line by line both ways along the same offset, and the
lines of a later run of min_words words or more are deleted. The first run of all stays.

A common line is selected in many texts and would tie unrelated ones together, or hide a passage behind its own first place; that is
why a match needs an equal window around it. The text moves only within its own row; what is shuffled is a few longs for each line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, maybe_broadcast


#: Columns of the result that a kept one can't replace.
OWN = ("doc_id", "text", "n_lines", "n_removed")


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line that isn't blank: the document (id, h), the line's place among all lines and among these, hash, words."""
    line = F.trim("line")
    split = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("at", "line")).where(line != "")
    return split.select("doc_id", "h", "at", F.xxhash64(line).alias("hash"), F.size(F.split(line, " +")).alias("words"))


def numbered(docs: DataFrame, min_words: int) -> DataFrame:
    """_lines with i, a line's number among those that aren't blank, `spot`, the number of the line that its window selects, and window, the window's hash; null where no min_words words are left."""
    own = Window.partitionBy("doc_id", "h").orderBy("at")
    lines = _lines(docs).repartition("doc_id", "h").dropDuplicates(["doc_id", "h", "at"])
    lines = lines.withColumn("i", F.row_number().over(own)).withColumn("before", F.sum("words").over(own) - F.col("words"))
    # lines that begin within min_words of this one's begin: the shortest run of that many words
    run = Window.partitionBy("doc_id", "h").orderBy("before").rangeBetween(0, min_words - 1)
    low = F.min(F.struct("hash", (-F.col("i")).alias("i"))).over(run)
    lines = lines.select("doc_id", "h", "at", "i", "hash", "words", F.sum("words").over(run).alias("total"), low.alias("low"), F.xxhash64(F.collect_list("hash").over(run)).alias("window"))
    whole = F.col("total") >= min_words
    return lines.select("doc_id", "h", "at", "i", "hash", "words", F.when(whole, -F.col("low.i")).alias("spot"), F.when(whole, F.col("low.hash")).alias("low"), F.when(whole, F.col("window")).alias("window"))


def fingerprints(lines: DataFrame) -> DataFrame:
    """(doc_id, h, spot, low, windows): the selected positions of numbered lines, their line's hash, and (i, window) of the windows that selected them."""
    return lines.where("spot is not null").groupBy("doc_id", "h", "spot").agg(F.first("low").alias("low"), F.collect_list(F.struct("i", "window")).alias("windows"))


def repeated_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, h, runs): for each text with later repeated runs, array<struct<first, last>> of line places, both included."""
    lines = materialize(numbered(docs, min_words), "lines")
    spots = fingerprints(lines)
    common = spots.groupBy("low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("low")
    marks = materialize(spots.join(common, "low").select("doc_id", "h", F.inline("windows")), "marks")
    first = marks.groupBy("window").agg(F.min(F.struct("doc_id", "h", "i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    at_first = F.struct("doc_id", "h", "i")
    matches = marks.join(first, "window").where(at_first != F.col("first"))
    # where a match leads: the same offset to the same text is one alignment
    aligned = matches.select("doc_id", "h", F.col("first.doc_id").alias("doc0"), F.col("first.h").alias("h0"), (F.col("i") - F.col("first.i")).alias("shift")).distinct()
    aligned = materialize(aligned, "aligned")
    here = lines.select("doc_id", "h", "at", "i", "hash", "words").join(aligned, ["doc_id", "h"])
    there = lines.select(F.col("doc_id").alias("doc0"), F.col("h").alias("h0"), F.col("i").alias("i0"), "hash")
    there = there.join(aligned.select("doc0", "h0").distinct(), ["doc0", "h0"], "left_semi")
    same = here.withColumn("i0", F.col("i") - F.col("shift")).join(there, ["doc0", "h0", "i0", "hash"])
    along = Window.partitionBy("doc_id", "h", "doc0", "h0", "shift").orderBy("i")
    same = same.withColumn("island", F.col("i") - F.row_number().over(along))
    runs = same.groupBy("doc_id", "h", "doc0", "h0", "shift", "island").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("words").alias("total")).where(F.col("total") >= min_words)
    out = materialize(runs.groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "runs")
    discard(lines, aligned, marks)
    return out


def dedup_lines(docs: DataFrame, min_words: int = 50, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of docs as (keep..., doc_id, text, n_lines, n_removed) with later repeated runs of lines deleted.

    A line is what stands between newlines; lines are equal when they are but for spaces at their ends; words are parted by spaces.
    Earlier and later are by ascending doc_id, then place; of different texts under one doc_id, by the hash of the text. Blank lines
    never count, and go only inside a deleted run. Rows that repeat a doc_id and its text are one document and get the same text. A
    null text becomes an empty one; with a null doc_id a text stays as it is and no other text is compared with it. Columns of docs
    that are not in keep are not read; kept ones may have any names, but the id, the text and OWN are the result's alone.
    """
    names = [c for c in dict.fromkeys(keep or []) if c.lower() not in (id_col.lower(), text_col.lower(), *OWN)]
    row = F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(f"c{k}") for k, c in enumerate(names))) if names else F.lit(0)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row.alias("row"))
    runs = repeated_runs(docs.select("doc_id", "text").where("doc_id is not null and text <> ''"), min_words)
    size = runs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("r")).first()
    runs = maybe_broadcast(runs.select(F.col("doc_id").alias("id"), "h", "runs"), size.n + size.r)
    docs = docs.join(runs, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("h")), "left")
    gone = lambda i: F.exists("runs", lambda r: (r["first"] <= i) & (i <= r["last"]))
    left = F.filter(F.split("text", "\n"), lambda line, i: ~gone(i))
    lines = F.size(F.split("text", "\n"))
    out = docs.withColumn("left", F.when(F.col("runs").isNotNull(), left))
    text = F.when(F.col("left").isNotNull(), F.array_join("left", "\n")).otherwise(F.col("text"))
    removed = F.when(F.col("left").isNotNull(), lines - F.size("left")).otherwise(F.lit(0))
    return out.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)), "doc_id", text.alias("text"), lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


#: The same in SQL, with texts in place of hashes; {w} is min_words.
SQL = """
with numbered as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
split as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as spot
          from (select distinct doc_id, text from numbered where doc_id is not null and text <> '')),
numbered_lines as (select doc_id, spot, trim(line) as line, len(regexp_split_to_array(trim(line), ' +')) as words,
                   row_number() over (partition by doc_id order by spot) as i from split where trim(line) <> ''),
placed as (select *, coalesce(sum(words) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as before from numbered_lines),
windows as (select *, sum(words) over run as total, string_agg(line, chr(10)) over run as win from placed
            window run as (partition by doc_id order by before range between current row and {w} - 1 following)),
firsts as (select win, min(struct_pack(d := doc_id, i := i)) as f from windows where total >= {w} group by win having count(*) > 1),
aligned as (select distinct w.doc_id, f.d as doc0, w.i - f.i as shift from windows w join firsts using (win)
            where w.total >= {w} and not (w.doc_id = f.d and w.i = f.i)),
same as (select a.doc_id, a.doc0, a.shift, l.spot, l.i, l.words from aligned a join numbered_lines l on l.doc_id = a.doc_id
         join numbered_lines m on m.doc_id = a.doc0 and m.i = l.i - a.shift and m.line = l.line),
islands as (select *, i - row_number() over (partition by doc_id, doc0, shift order by i) as island from same),
runs as (select doc_id, min(spot) as a, max(spot) as b from islands group by doc_id, doc0, shift, island having sum(words) >= {w}),
every as (select r, doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as spot from numbered),
marked as (select e.r, e.doc_id, e.spot, e.line, max(case when x.a is null then 0 else 1 end) as gone
           from every e left join runs x on x.doc_id = e.doc_id and e.spot between x.a and x.b group by e.r, e.doc_id, e.spot, e.line)
select doc_id, coalesce(string_agg(line, chr(10) order by spot) filter (gone = 0), '') as text, count(*)::bigint as n_lines, sum(gone)::bigint as n_removed from marked group by r, doc_id
"""
