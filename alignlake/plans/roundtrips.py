"""Readers and sinks as queries: records derived from the driver's tables are written to a scratch folder and read back.

Files hold what real ones do: wrapped blocks, ``\\r\\n`` ends, separators with blanks around them, names used twice,
lines that a reader must leave out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignlake.operators import alignment as A
from alignlake.operators import packed as P
from alignlake.operators import sequences as S
from alignlake.plans import inputs as I
from alignlake.scratch import scratch_dir
from alignlake.sources import formats, records, stockholm, text

QUERIES, ORACLES = {}, {}
#: Columns of a wrapped block.
WRAP = 60


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def _save(lines: DataFrame, *by: str) -> str:
    """Write ``value`` as text, a folder for each value of ``by``."""
    path = scratch_dir(lines.sparkSession)
    lines.select(*by, "value").write.partitionBy(*by).text(path)
    return path


def _rows(spark, sf_dir) -> DataFrame:
    """Rows of alignments that have a column, numbered without holes."""
    return I.rows(spark, sf_dir).where("gapped != ''")


_ROWS = f"{I.ROWS}, r AS (SELECT * FROM rows_ WHERE gapped <> '')"


def _in_order(*text: Column, sep: str = "\n") -> Column:
    """The lines of a group's rows, by row number."""
    lines = F.array_sort(F.collect_list(F.struct("row_no", *(t.alias(f"t{i}") for i, t in enumerate(text)))))
    return F.array_join(F.transform(lines, lambda x: F.concat_ws(sep, *(x[f"t{i}"] for i in range(len(text))))), "\n")


def _docs(spark, sf_dir) -> DataFrame:
    return I.sequences(spark, sf_dir).select("seq_id", F.coalesce("lang", F.lit("")).alias("descr"), F.coalesce("seq", F.lit("")).alias("seq"))


_DOCS = f"{I.SEQUENCES}, d AS (SELECT seq_id, coalesce(lang, '') AS descr, coalesce(seq, '') AS seq FROM sequences)"


@query(f"WITH {_DOCS} SELECT * FROM d")
def s1_read_fasta(spark, sf_dir):
    """Half of the records end their lines with ``\\r\\n`` and have blanks inside."""
    wrapped = F.regexp_replace("seq", "(.{50})(?=.)", "$1 \n")
    record = F.concat(F.lit(">"), "seq_id", F.lit("  "), "descr", F.lit(" \n"), wrapped)
    odd = F.col("seq_id").cast("long") % 2 == 1
    path = _save(_docs(spark, sf_dir).select(F.when(odd, F.concat(F.replace(record, F.lit("\n"), F.lit("\r\n")), F.lit("\r"))).otherwise(record).alias("value")))
    return text.read_fasta(spark, path)


def _fasta_rows(spark, sf_dir):
    rows = I.raw_rows(spark, sf_dir).where("gapped != ''")
    return rows.select(F.concat_ws("/", "aln_id", "name").alias("seq_id"), F.lit("").alias("descr"), F.col("gapped").alias("seq"))


@query(f"WITH {I.ROWS} SELECT 'all' AS aln_id, aln_id || '/' || name AS name, gapped FROM raw_ WHERE gapped <> ''")
def s2_read_gapped_fasta(spark, sf_dir):
    path = scratch_dir(spark)
    text.write_fasta(_fasta_rows(spark, sf_dir), path)
    return records.read_gapped_fasta(spark, path, "all")


@query(f"WITH {I.ROWS} SELECT 'all' AS aln_id, count(*) AS n_rows, count(DISTINCT name) AS n_names, count(DISTINCT length(gapped)) AS n_lengths FROM raw_ WHERE gapped <> ''")
def s2_gapped_fasta_faults(spark, sf_dir):
    path = scratch_dir(spark)
    names = F.regexp_extract("seq_id", "/(.*)$", 1)
    text.write_fasta(_fasta_rows(spark, sf_dir).withColumn("seq_id", names), path)
    return records.faults(records.read_gapped_fasta(spark, path, "all"))


def _database(spark, sf_dir) -> str:
    """Wrapped databases: rows with ``PP`` of all but the first row, ``RF`` of the first, tags; records end in ``//``, some with blanks around it."""
    rows = _rows(spark, sf_dir)
    piece = lambda c, i: F.substring(c, 1 + WRAP * i, WRAP if not i else 1 << 30)
    pp = F.regexp_replace("gapped", "[a-m]", "q")

    def block(i: int) -> Column:
        own = F.when(F.length(piece("gapped", i)) > 0, F.concat(F.col("name"), F.lit("   "), piece("gapped", i)))
        note = F.when((F.col("row_no") > 0) & (F.length(piece("gapped", i)) > 0), F.concat(F.lit("#=GR "), "name", F.lit(" PP "), piece(pp, i)))
        return _in_order(own, note)

    first = F.first(F.when(F.col("row_no") == 0, F.upper("gapped")), ignorenulls=True)
    each = rows.groupBy("aln_id").agg(block(0).alias("b0"), block(1).alias("b1"), first.alias("rf"), F.count("*").alias("n"))
    gc = lambda i: F.when(F.length(piece("rf", i)) > 0, F.concat(F.lit("\n#=GC RF "), piece("rf", i)))
    end = F.element_at(F.array(F.lit("//"), F.lit("// "), F.lit(" //\t")), (F.col("aln_id").cast("int") % 3 + 1))
    body = F.concat_ws("", F.lit("# STOCKHOLM 1.0\n#=GF ID "), "aln_id", F.lit("\n#=GF CC rows "), "n", F.lit("\n#=GF CC  of one\n#=GS x NO note\n"), "b0", gc(0), F.lit("\n\n"), "b1", gc(1), F.lit("\n"), end)
    return _save(each.select(body.alias("value")))


@query(f"WITH {_ROWS} SELECT aln_id, (row_number() OVER (PARTITION BY aln_id ORDER BY row_no) - 1)::INTEGER AS row_no, name, gapped FROM r")
def s3_read_database(spark, sf_dir):
    return stockholm.read_database(spark, _database(spark, sf_dir))["aln_rows"].select("aln_id", "row_no", "name", "gapped")


@query(f"""WITH {_ROWS}, n AS (SELECT aln_id, count(*) AS n FROM r GROUP BY aln_id)
SELECT aln_id, 'PP' AS tag, name, regexp_replace(gapped, '[a-m]', 'q', 'g') AS text FROM r WHERE row_no > 0 UNION ALL SELECT aln_id, 'RF', NULL, upper(gapped) FROM r WHERE row_no = 0
UNION ALL SELECT aln_id, 'ID', NULL, aln_id FROM n UNION ALL SELECT aln_id, 'CC', NULL, 'rows ' || n FROM n UNION ALL SELECT aln_id, 'CC', NULL, 'of one' FROM n UNION ALL SELECT aln_id, 'NO', 'x', 'note' FROM n""")
def s3_database_annotations(spark, sf_dir):
    found = stockholm.read_database(spark, _database(spark, sf_dir))
    none = F.lit(None).cast("string").alias("name")
    notes = found["cell_annot"].select("record", "tag", "name", "text").unionByName(found["col_annot"].select("record", "tag", none, "text"))
    notes = notes.unionByName(found["aln_tags"].select("record", "tag", none, F.col("value").alias("text"))).unionByName(found["row_tags"].select("record", "tag", "name", F.col("value").alias("text")))
    return notes.join(found["aln_rows"].select("record", "aln_id").distinct(), "record").select("aln_id", "tag", "name", "text")


@query(f"""WITH {_DOCS}, {_ROWS} SELECT 'fasta' AS form, seq_id AS aln_id, 0 AS row_no, seq_id AS name, seq AS gapped FROM d
UNION ALL SELECT 'database', aln_id, (row_number() OVER (PARTITION BY aln_id ORDER BY row_no) - 1)::INTEGER, name, gapped FROM r""")
def s4_read_any(spark, sf_dir):
    path = scratch_dir(spark)
    text.write_fasta(_docs(spark, sf_dir), path)
    return stockholm.read_any(spark, path).withColumn("form", F.lit("fasta")).unionByName(stockholm.read_any(spark, _database(spark, sf_dir)).withColumn("form", F.lit("database")))


@query("""SELECT event_type AS seqname, 'log' AS source, 'e' AS type, user_id::INTEGER AS start, (user_id + 10)::INTEGER AS "end", CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 100 + 0.5 END::DOUBLE AS score,
CASE event_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand, CASE WHEN event_id % 4 < 3 THEN (event_id % 4)::INTEGER END AS frame, event_id::VARCHAR AS id FROM events WHERE event_id % 7 <> 0""")
def s5_read_gff(spark, sf_dir):
    """Comments and lines of eight fields go; unknown strands, frames and scores are told apart."""
    t = I.table(spark, sf_dir, "events")
    e = F.col("event_id")
    score = F.when(e % 5 == 0, ".").otherwise((e % 100 + 0.5).cast("string"))
    strand, frame = F.element_at(F.array(*map(F.lit, "+-?")), (e % 3 + 1).cast("int")), F.element_at(F.array(*map(F.lit, "012x")), (e % 4 + 1).cast("int"))
    line = F.concat_ws("\t", "event_type", F.lit("log"), F.lit("e"), "user_id", F.col("user_id") + 10, score, strand, frame, F.when(e % 7 != 0, F.concat(F.lit("ID="), e)))
    path = _save(t.select(F.when(e % 11 == 0, F.concat(F.lit("##gff-version 3\n"), line)).otherwise(line).alias("value")))
    got = text.read_gff(spark, path)
    return got.select("seqname", "source", "type", "start", "end", "score", "strand", "frame", F.col("attrs")["ID"][0].alias("id"))


@query("""SELECT event_type AS seqname, user_id::INTEGER AS start, value AS score, CASE WHEN event_id % 2 = 0 THEN 1 END AS frame, event_id || ';=,' || event_type AS id, 'a,b|c=d' AS note FROM events""")
def s16_write_gff(spark, sf_dir):
    t = I.table(spark, sf_dir, "events")
    attrs = F.create_map(F.lit("ID"), F.array(F.concat("event_id", F.lit(";=,"), "event_type")), F.lit("note"), F.array(F.lit("a,b"), F.lit("c=d")))
    at = F.col("user_id").cast("int")
    features = t.select(F.col("event_type").alias("seqname"), F.lit("s").alias("source"), F.lit("e").alias("type"), at.alias("start"), at.alias("end"), F.col("value").alias("score"), F.lit("+").alias("strand"), F.when(F.col("event_id") % 2 == 0, 1).alias("frame"), attrs.alias("attrs"))
    path = scratch_dir(spark)
    text.write_gff(features, path)
    got = text.read_gff(spark, path)
    return got.select("seqname", "start", "score", "frame", F.col("attrs")["ID"][0].alias("id"), F.array_join(F.col("attrs")["note"], "|").alias("note"))


@query(f"""WITH {_ROWS} SELECT aln_id AS score, split_part(name, '-', 1) AS name, row_no::BIGINT AS start, length(replace(gapped, '-', ''))::BIGINT AS size, '+' AS strand, length(gapped)::BIGINT AS src_size, gapped,
CASE WHEN row_no % 3 > 0 THEN translate(gapped, 'abc', '019') END AS quality FROM r""")
def s6_read_maf(spark, sf_dir):
    """Names are roles, so a block has some of them several times; every third row has no quality line."""
    name = F.substring_index("name", "-", 1)
    s = F.concat_ws(" ", F.lit("s"), name, "row_no", F.length(F.translate("gapped", "-", "")), F.lit("+"), F.length("gapped"), "gapped")
    q = F.when(F.col("row_no") % 3 > 0, F.concat_ws(" ", F.lit("q"), name, F.translate("gapped", "abc", "019")))
    each = _rows(spark, sf_dir).groupBy("aln_id").agg(_in_order(s, F.concat(F.lit("i "), name, F.lit(" N 0 C 0")), q).alias("body"))
    path = _save(each.select(F.concat(F.lit("# block\na score="), "aln_id", F.lit(" pass=1\n"), "body", F.lit("\n")).alias("value")))
    got = records.read_maf(spark, path)
    return got.select(F.col("tags")["score"].alias("score"), "name", "start", "size", "strand", "src_size", "gapped", "quality")


def _interleaved(spark, sf_dir, form: str) -> DataFrame:
    chunk = lambda i: F.substring("gapped", 1 + WRAP * i, WRAP if not i else 1 << 30)
    spaced = (lambda c: F.regexp_replace(c, "(.{10})(?=.)", "$1 ")) if form == "msf" else (lambda c: c)
    part = lambda i: _in_order(F.when(F.length(chunk(i)) > 0, F.concat(F.col("name"), F.lit("    "), spaced(chunk(i)))))
    head = F.lit("CLUSTAL W (1.83)\n\n" if form == "clustal" else " x.msf MSF: 9 Type: P\n\n Name: user Len: 9\n\n//\n\n")
    stars = F.lit("\n      *:. \n\n" if form == "clustal" else "\n\n")
    each = _rows(spark, sf_dir).groupBy("aln_id").agg(part(0).alias("b0"), part(1).alias("b1"))
    path = _save(each.select(F.col("aln_id").alias("aln"), F.concat(head, "b0", stars, "b1").alias("value")), "aln")
    got = formats.read_interleaved(spark, path, form)
    return got.select(F.regexp_extract("file", r"aln=([^/]+)/", 1).alias("aln_id"), "row_no", "name", "gapped")


_INTERLEAVED = f"WITH {_ROWS} SELECT aln_id, (row_number() OVER (PARTITION BY aln_id ORDER BY row_no) - 1)::INTEGER AS row_no, name"


@query(f"{_INTERLEAVED}, gapped FROM r")
def s7_read_clustal(spark, sf_dir):
    return _interleaved(spark, sf_dir, "clustal")


@query(f"{_INTERLEAVED}, replace(gapped, '-', '.') AS gapped FROM r")
def s7_read_msf(spark, sf_dir):
    return _interleaved(spark, sf_dir, "msf")


@query(f"WITH {_ROWS} SELECT aln_id AS group_id, name, gapped, CASE WHEN aln_id::INTEGER % 2 = 0 THEN '(a,b)' || aln_id || ';' END AS tree FROM r")
def s8_read_family_table(spark, sf_dir):
    """Compressed, with comment lines; every second group has a tree."""
    rows = _rows(spark, sf_dir)
    path = scratch_dir(spark)
    line = F.concat_ws("\t", "aln_id", "name", "gapped")
    rows.select(F.when(F.col("row_no") == 0, F.concat(F.lit("# group name row\n"), line)).otherwise(line)).write.option("compression", "gzip").text(path)
    trees = rows.select(F.col("aln_id").alias("group_id")).distinct().where("cast(group_id as int) % 2 = 0")
    return formats.read_family_table(spark, path, trees.withColumn("tree", F.concat(F.lit("(a,b)"), "group_id", F.lit(";"))))


@query(f"""WITH {_ROWS}, m AS (SELECT aln_id, count(*) AS n FROM r GROUP BY aln_id) SELECT 0 AS line_no, 'family' AS tag, aln_id AS value FROM m
UNION ALL SELECT row_number() OVER (PARTITION BY aln_id ORDER BY row_no)::INTEGER, 'ROW', name || '  ' || gapped FROM r UNION ALL SELECT n + 1, 'END', '' FROM m""")
def s9_read_tagged_records(spark, sf_dir):
    each = _rows(spark, sf_dir).groupBy("aln_id").agg(_in_order(F.concat(F.lit("ROW "), "name", F.lit("  "), "gapped")).alias("body"))
    path = _save(each.select(F.concat(F.lit("FAM "), "aln_id", F.lit("\n"), "body", F.lit("\nEND\n//")).alias("value")))
    return formats.read_tagged_records(spark, path, {"FAM": "family"}).select("line_no", "tag", "value")


@query(f"""WITH {_ROWS}, x AS (SELECT aln_id, 0 AS iteration, row_no, name, gapped FROM r UNION ALL SELECT aln_id, 20, row_no, name, reverse(gapped) FROM r)
SELECT aln_id, iteration::BIGINT AS iteration, (row_number() OVER (PARTITION BY aln_id, iteration ORDER BY row_no) - 1)::INTEGER AS row_no, name, gapped FROM x""")
def s10_read_trace(spark, sf_dir):
    """Two samples of each alignment, wrapped."""
    body = lambda c: _in_order(F.concat(F.lit("> "), F.col("name")), F.regexp_replace(c, "(.{60})(?=.)", "$1\n"))
    each = _rows(spark, sf_dir).groupBy("aln_id").agg(body(F.col("gapped")).alias("a"), body(F.reverse("gapped")).alias("b"))
    path = _save(each.select(F.col("aln_id").alias("aln"), F.concat(F.lit("iterations = 0\n"), "a", F.lit("\n\niterations = 20\n\n"), "b").alias("value")), "aln")
    got = formats.read_trace(spark, path)["samples"]
    return got.select(F.regexp_extract("file", r"aln=([^/]+)/", 1).alias("aln_id"), "iteration", "row_no", "name", "gapped")


@query("""SELECT o_orderkey AS iteration, unnest(['price', 'who']) AS param, unnest([o_totalprice::DOUBLE, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END::DOUBLE]) AS value FROM orders""")
def s10_trace_params(spark, sf_dir):
    t = I.table(spark, sf_dir, "orders")
    path = scratch_dir(spark)
    who = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("none")
    t.select(F.col("o_orderkey").alias("iter"), F.col("o_totalprice").alias("price"), who.alias("who")).write.option("header", True).csv(path, sep="\t")
    return formats.read_trace(spark, _save(t.select(F.lit("iterations = 0").alias("value")).limit(1)), params=path)["params"]


@query("""WITH s AS (SELECT doc_id::VARCHAR AS name, regexp_replace(lower(text), '[^a-z]', '', 'g') AS seq FROM documents)
SELECT name, seq, regexp_replace(translate(seq, 'en', '<>'), '[^<>]', '.', 'g') AS brackets FROM s WHERE seq <> ''""")
def s11_read_folds(spark, sf_dir):
    t = I.sequences(spark, sf_dir).where("seq != ''")
    brackets = F.regexp_replace(F.translate("seq", "en", "()"), "[^()]", ".")
    return records.read_folds(spark, _save(t.select(F.concat(F.lit(">"), "seq_id", F.lit(" fold\n"), "seq", F.lit("\n"), brackets, F.lit(" (-1.20)")).alias("value"))))


@query(f"""WITH {I.ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY row_no) - 1 AS k, count(*) OVER (PARTITION BY aln_id) AS n FROM raw_)
SELECT aln_id AS tree, (k + k // 2)::INTEGER AS node, (k - k % 2 + k // 2 + least(2, n - (k - k % 2)))::INTEGER AS parent, name, ((k % 4) * 0.25)::DOUBLE AS branch_len FROM r
UNION ALL SELECT aln_id, (k + k // 2 + least(2, n - k))::INTEGER, (n + (n + 1) // 2)::INTEGER, NULL, NULL FROM r WHERE k % 2 = 0
UNION ALL SELECT aln_id, (n + (n + 1) // 2)::INTEGER, NULL, aln_id, NULL FROM r WHERE k = 0""")
def s12_read_trees(spark, sf_dir):
    """A tree for each conversation: its turns in pairs below nodes without names, those below the root; quoted names, comments."""
    rows = I.raw_rows(spark, sf_dir).withColumn("k", F.expr("row_number() over (partition by aln_id order by row_no) - 1"))
    leaf = F.concat(F.lit("'"), "name", F.lit("'[note]: "), ((F.col("k") % 4) * 0.25).cast("string"))
    pairs = rows.groupBy("aln_id", F.expr("k div 2 as p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", leaf.alias("t")))), lambda x: x["t"]), " ,\n").alias("t"))
    trees = pairs.groupBy("aln_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: F.concat(F.lit("("), x["t"], F.lit(")"))), ",").alias("t"))
    nodes = formats.read_trees(spark, _save(trees.select(F.concat(F.lit("("), "t", F.lit(")"), "aln_id", F.lit(";")).alias("value"))))
    roots = nodes.where("parent is null").select("tree_id", F.col("name").alias("tree"))
    return nodes.join(roots, "tree_id").select("tree", "node", "parent", "name", "branch_len")


@query("""SELECT user_id::VARCHAR AS date, 'x.cc' AS src_file, (event_id % 1000)::INTEGER AS src_line, CASE WHEN event_id % 3 > 0 THEN (event_id % 9)::INTEGER END AS level, event_type || '|t' AS tags, unnest(['first ' || event_id, 'second']) AS text FROM events""")
def s13_read_log(spark, sf_dir):
    t = I.table(spark, sf_dir, "events")
    level = F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 9).cast("string")).otherwise("high")
    head = F.format_string("<log date='%s' time='now' file='x.cc' line='%s' level='%s' tags='%s, t'>", F.col("user_id").cast("string"), (F.col("event_id") % 1000).cast("string"), level, "event_type")
    got = records.read_log(spark, _save(t.select(F.concat(head, F.lit("\nfirst "), "event_id", F.lit("\n\nsecond")).alias("value"))))
    return got.select("date", "src_file", "src_line", "level", F.array_join("tags", "|").alias("tags"), "text")


@query(f"WITH {I.ANNOTATED} SELECT aln_id, kind, name, tag, text FROM texts WHERE text <> '' UNION ALL SELECT DISTINCT aln_id, 'tag', NULL, 'ID', aln_id FROM texts WHERE text <> ''")
def s14_write_database(spark, sf_dir):
    """What is written is read again: rows, annotations and tags."""
    texts = P.unpack(I.annotated(spark, sf_dir)).where("text != ''").withColumn("record", F.xxhash64("aln_id"))
    own = texts.select("record", "aln_id").distinct()
    nothing = own.where("false")
    tables = {
        "aln_rows": texts.where("kind = 'row'").select("record", "aln_id", "row_no", "name", F.col("text").alias("gapped")),
        "aln_tags": own.select("record", F.lit(0).alias("line_no"), F.lit("ID").alias("tag"), F.col("aln_id").alias("value")),
        "row_tags": nothing.select("record", F.lit(0).alias("line_no"), F.lit("").alias("name"), F.lit("").alias("tag"), F.lit("").alias("value")),
        "col_annot": texts.where("kind = 'col'").select("record", "tag", "text"),
        "cell_annot": texts.where("kind = 'cell'").select("record", "name", "tag", "text"),
    }
    path = scratch_dir(spark)
    stockholm.write_database(tables, path)
    got = stockholm.read_database(spark, path)
    none = lambda c: F.lit(None).cast("string").alias(c)
    found = got["aln_rows"].select("record", F.lit("row").alias("kind"), "name", none("tag"), F.col("gapped").alias("text"))
    found = found.unionByName(got["col_annot"].select("record", F.lit("col").alias("kind"), none("name"), "tag", "text")).unionByName(got["cell_annot"].select("record", F.lit("cell").alias("kind"), "name", "tag", "text"))
    found = found.unionByName(got["aln_tags"].select("record", F.lit("tag").alias("kind"), none("name"), "tag", F.col("value").alias("text")))
    return found.join(got["aln_rows"].select("record", "aln_id").distinct(), "record").select("aln_id", "kind", "name", "tag", "text")


@query(f"""WITH {_ROWS}, s AS (SELECT aln_id || '/' || name AS id, replace(gapped, '-', '') AS seq FROM r)
SELECT '>' || id AS value FROM s UNION ALL SELECT substr(seq, i::BIGINT, 50) FROM (SELECT seq, unnest(range(1, greatest(length(seq), 1) + 1, 50)) AS i FROM s)""")
def s15_write_fasta(spark, sf_dir):
    """The lines of a file without gaps, wrapped at fifty, in order of names."""
    rows = _rows(spark, sf_dir).select(F.concat_ws("/", "aln_id", "name").alias("seq_id"), F.lit("").alias("descr"), F.col("gapped").alias("seq"))
    path = scratch_dir(spark)
    text.write_fasta(rows, path, 50, gapped=False, sort=True)
    return spark.read.text(path)


_FIRST = f"{I.CELLS}, f AS (SELECT aln_id, pos, ch FROM cells WHERE row_no = 0 AND NOT is_gap)"


@query(f"""WITH {_FIRST} SELECT (pos % 10 + 0.5)::DOUBLE::VARCHAR AS value FROM f UNION ALL SELECT unnest(['track type=wiggle_0 name=t', 'fixedStep chrom=' || aln_id || ' start=0 step=1']) FROM (SELECT DISTINCT aln_id FROM f)""")
def s17_write_wig(spark, sf_dir):
    cells = I.residues(spark, sf_dir).where("row_no = 0")
    path = scratch_dir(spark)
    records.write_wig(cells.select(F.col("aln_id").alias("seq_id"), F.lit("t").alias("track"), "pos", (F.col("pos") % 10 + 0.5).cast("double").alias("value")), path)
    return spark.read.text(path)


@query(f"""WITH {_FIRST}, m AS (SELECT aln_id, pos, CASE WHEN ch = 'e' THEN 1 ELSE -1 END AS step FROM f WHERE ch IN ('e', 'n')),
d AS (SELECT *, sum(step) OVER (PARTITION BY aln_id ORDER BY pos) + CASE WHEN step = 1 THEN 0 ELSE 1 END AS depth FROM m),
l AS (SELECT *, lead(pos) OVER (PARTITION BY aln_id, depth ORDER BY pos) AS nxt, lead(step) OVER (PARTITION BY aln_id, depth ORDER BY pos) AS nxt_step FROM d),
p AS (SELECT aln_id, pos, nxt AS "to" FROM l WHERE step = 1 AND nxt_step = -1), e AS (SELECT * FROM p UNION ALL SELECT aln_id, "to", pos FROM p)
SELECT printf('%3d %s %7d %4d %4d %4d', pos + 1, ch, pos, pos + 2, coalesce("to" + 1, 0), pos + 1) AS value FROM f LEFT JOIN e USING (aln_id, pos)
UNION ALL SELECT printf('%d ENERGY = 0    %s    %d bp RNA', count(*)::INTEGER, aln_id, count(*)::INTEGER) FROM f GROUP BY aln_id""")
def s18_write_ct(spark, sf_dir):
    first = A.ungap(I.rows(spark, sf_dir).where("row_no = 0")).where("seq != ''").select(F.col("aln_id").alias("name"), "seq")
    marks = I.residues(spark, sf_dir).where("row_no = 0 and ch in ('e', 'n')").select(F.col("aln_id").alias("id"), F.col("pos").alias("col"), F.when(F.col("ch") == "e", "<").otherwise(">").alias("ch"))
    pairs = S.bracket_pairs(marks).select(F.col("id").alias("name"), F.col("lcol").alias("lpos"), F.col("rcol").alias("rpos"))
    path = scratch_dir(spark)
    formats.write_ct(first, pairs, path)
    return spark.read.text(path).select("value")


@query(f"""WITH {_ROWS}, k AS (SELECT *, dense_rank() OVER (ORDER BY aln_id::INTEGER) - 1 AS n FROM r WHERE aln_id::INTEGER % 5 <> 0)
SELECT 'Sample ' || n || chr(9) || 'Alignment:' || chr(9) || unnest(['>' || name, gapped]) AS value FROM k WHERE row_no <> 1""")
def s19_write_trace(spark, sf_dir):
    """Every fifth sample is a refined one, every second row an inner node of its tree."""
    rows = _rows(spark, sf_dir).withColumn("sample", F.col("aln_id").cast("int"))
    path = scratch_dir(spark)
    formats.write_trace(rows.withColumn("type", F.when(F.col("sample") % 5 == 0, "Refined")), path, rows.where("row_no = 1").select("sample", "name"))
    return spark.read.text(path)


@query(f"WITH {I.CELLS} SELECT * FROM cells")
def s20_save_cells(spark, sf_dir):
    path = scratch_dir(spark)
    formats.save_cells(I.cells(spark, sf_dir), path)
    return spark.read.parquet(path)


@query(f"WITH {I.ANNOTATED} SELECT * FROM texts")
def s20_save_packed(spark, sf_dir):
    path = scratch_dir(spark)
    P.write_packed(I.annotated(spark, sf_dir), path)
    return P.unpack(P.read_packed(spark, path))


@query(f"""WITH {_ROWS} SELECT aln_id, (row_number() OVER (PARTITION BY aln_id ORDER BY row_no) - 1)::INTEGER AS row_no, name, gapped FROM r
UNION ALL SELECT aln_id, NULL, 'SS_cons', translate(regexp_replace(gapped, '[^en]', '.', 'g'), 'en', '<>') FROM r WHERE row_no = 0""")
def s21_read_column_format(spark, sf_dir):
    line = F.concat(F.lit("; ALIGN  "), F.col("name"), F.lit("  "), F.regexp_replace("gapped", "(.{10})(?=.)", "$1 "))
    marks = F.first(F.when(F.col("row_no") == 0, F.translate(F.regexp_replace("gapped", "[^en]", "."), "en", "()")), ignorenulls=True)
    begin = F.concat(F.lit("; ALIGN "), F.col("name"), F.lit(" Begin"))
    each = _rows(spark, sf_dir).groupBy("aln_id").agg(_in_order(begin).alias("names"), _in_order(line).alias("rows"), marks.alias("ss"))
    value = F.concat(F.lit("; TYPE col\n"), "names", F.lit("\n"), "rows", F.lit("\n; ALIGN Structure "), F.regexp_replace("ss", "(.{7})(?=.)", "$1 "), F.lit("\n; ALIGN Structure End\nother"))
    got = formats.read_column_format(spark, _save(each.select(F.col("aln_id").alias("aln"), value.alias("value")), "aln"))
    aln = F.regexp_extract("file", r"aln=([^/]+)/", 1).alias("aln_id")
    note = got["col_annot"].select(aln, F.lit(None).cast("int").alias("row_no"), F.col("tag").alias("name"), F.col("text").alias("gapped"))
    return got["rows"].select(aln, "row_no", "name", "gapped").unionByName(note)


@query(f"""WITH {_ROWS} SELECT aln_id AS family, 'row' AS kind, name, NULL::VARCHAR AS tag, gapped AS text FROM r UNION ALL SELECT aln_id, 'cell', name, 'loop kind', upper(gapped) FROM r
UNION ALL SELECT DISTINCT aln_id, 'tag', NULL, unnest(['class', 'family']), unnest(['all ' || aln_id, 'f ' || aln_id]) FROM r""")
def s22_read_family_dirs(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    head = F.concat(F.lit(">P1;"), F.col("name"))
    ali = rows.groupBy("aln_id").agg(_in_order(head, F.lit("sequence"), F.concat(F.regexp_replace("gapped", "(.{60})(?=.)", "$1\n"), F.lit("*"))).alias("body"))
    ali = ali.select(F.col("aln_id").alias("family"), F.lit("x.ali").alias("file"), F.concat(F.lit("C; class: all "), "aln_id", F.lit("\nC; family: f "), "aln_id", F.lit(" \n"), "body").alias("value"))
    tem = rows.groupBy("aln_id").agg(_in_order(head, F.lit("sequence"), F.concat(F.col("gapped"), F.lit("*")), head, F.lit("loop kind"), F.concat(F.regexp_replace(F.upper("gapped"), "(.{60})(?=.)", "$1\n"), F.lit("*"))).alias("value"))
    tem = tem.select(F.col("aln_id").alias("family"), F.lit("x.tem").alias("file"), "value")
    got = formats.read_family_dirs(spark, _save(ali.unionByName(tem), "family", "file"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    family = F.regexp_replace("family", "^family=", "").alias("family")
    found = got["rows"].select(family, F.lit("row").alias("kind"), "name", none("tag"), F.col("gapped").alias("text"))
    found = found.unionByName(got["cell_annot"].select(family, F.lit("cell").alias("kind"), "name", "tag", "text"))
    return found.unionByName(got["tags"].select(family, F.lit("tag").alias("kind"), none("name"), "tag", F.col("value").alias("text")))


@query(f"""WITH {_ROWS} SELECT row_no::BIGINT AS "from", gapped, (row_no + length(replace(gapped, '-', '')))::BIGINT AS "to", aln_id || '/' || name AS name FROM r""")
def s23_plain_rows(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    end = (F.col("row_no") + F.length(F.translate("gapped", "-", ""))).cast("long")
    path = scratch_dir(spark)
    records.write_plain(rows.select(F.col("row_no").cast("long").alias("from"), "gapped", end.alias("to"), F.concat_ws("/", "aln_id", "name").alias("name")), path)
    return records.read_plain(spark, path)
