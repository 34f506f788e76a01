"""Documents, workbooks, schemas, seed tables, sinks and the file stream."""

import io
import struct
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import scoring
from quillspark.plans import storage
from quillspark.sources import documents, hwp, schema, seed, sinks, tables
from quillspark.streaming import intake


def packed(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def container(streams):
    """An OLE file: long streams in sectors, short ones in the pool; all siblings hang to the right."""
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    sectors, fat, pool, small_fat = [], [], b"", []

    def put(data):
        first = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, max(1, len(data)), 512)]
        sectors.extend(parts)
        fat.extend([*range(first + 1, first + len(parts)), end])
        return first

    def entry(name, kind, right=free, child=free, start=end, size=0):
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, free, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    placed = {}
    for path, data in streams.items():
        if len(data) >= 4096:
            placed[path] = put(data)
        else:
            n = max(1, -(-len(data) // 64))
            placed[path] = len(small_fat)
            small_fat.extend([*range(len(small_fat) + 1, len(small_fat) + n), end])
            pool += data.ljust(64 * n, b"\0")
    inner = [p for p in streams if "/" in p]
    entries = [entry("Root Entry", 5, child=1, start=put(pool), size=len(pool)), entry("FileHeader", 2, right=2, start=placed["FileHeader"], size=len(streams["FileHeader"])), entry("BodyText", 1, child=3)]
    for k, p in enumerate(inner):
        entries.append(entry(p.split("/")[1], 2, right=4 + k if k + 1 < len(inner) else free, start=placed[p], size=len(streams[p])))
    directory, small = put(b"".join(entries)), put(struct.pack(f"<{len(small_fat)}I", *small_fat).ljust(512, b"\xff"))
    at = len(sectors)
    fat.append(0xFFFFFFFD)
    assert len(fat) <= 128
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, 1, directory, 0, 4096, small, 1, end, 0, at)
    return head.ljust(512, b"\xff") + b"".join(sectors)


def record(tag, payload):
    size = len(payload)
    return struct.pack("<I", tag | min(size, 0xFFF) << 20) + (struct.pack("<I", size) if size >= 0xFFF else b"") + payload


def test_binary_documents():
    table = "\x0b" + "abcdefg"  # a control of eight units
    text = lambda s: record(67, s.encode("utf-16-le"))
    long = "가" * 5000
    body = [text("first" + table + "\t" + "1234567" + "x\r"), record(66, b"zz") + text(long)]
    for packed_ in (0, 1):
        pack = (lambda b: (c := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(b) + c.flush()) if packed_ else bytes
        streams = {"FileHeader": b"\0" * 36 + bytes([packed_]) + b"\0" * 200, "BodyText/Section10": pack(body[1]), "BodyText/Section2": pack(body[0])}
        assert hwp.hwp_text(container(streams)) == f"first\tx\n{long}\n"
    for broken in (b"", b"x" * 600, container(streams)[:700], container({**streams, "BodyText/Section2": b"\xff" * 80})):
        with pytest.raises(ValueError):
            hwp.hwp_text(broken)


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "g.hwp").write_bytes(container({"FileHeader": b"\0" * 236, "BodyText/Section0": record(67, "본문".encode("utf-16-le"))}))
    (tmp_path / "h.hwp").write_bytes(b"broken")
    (tmp_path / "a.hwpx").write_bytes(packed(**{"Contents/section1.xml": "<hp:p><hp:t>third</hp:t></hp:p>", "Contents/section0.xml": '<hp:p><hp:t>first &lt;1&gt;</hp:t></hp:p><hp:p><hp:t a="b">sec</hp:t><hp:t>ond</hp:t></hp:p>'}))
    (tmp_path / "sub/b.docx").write_bytes(packed(**{"word/document.xml": "<w:p><w:t>one &amp;</w:t></w:p><w:p><w:t>two</w:t></w:p>"}))
    (tmp_path / "c.txt").write_bytes("한글".encode("cp949"))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.html").write_text("<html><style>x</style><body class='a'>a  b<br>a b<p>d</p><p>d</p>c&nbsp;&lt;</body>")
    (tmp_path / "f.bin").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in documents.extract(documents.listing(spark, str(tmp_path))).collect()}
    assert got == {"a.hwpx": "first <1>\nsec\nond\nthird", "b.docx": "one &\ntwo", "c.txt": "한글", "d.docx": "", "g.hwp": "본문", "h.hwp": "", "e.html": "a b\nd\nd\nc <"}


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1"><v>1</v></c></row><row r="2"><c r="A2"><v>2</v></c></row></sheetData></worksheet>'


def test_small_packed_files_are_dealt_over_all_cores_and_share_batches(spark):
    """One small scan task makes many files; reading them is the work of all cores, and their rows do not go on file by file."""
    c = spark.range(64).selectExpr("id AS c_custkey").coalesce(1)
    files = storage._file(c, ".xlsx", "xl/worksheets/sheet1.xml", F.lit(SHEET))
    assert files.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    rows = documents.workbook_rows(files.coalesce(1))
    assert rows.count() == 128
    assert rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long").count() < 10
    assert sorted(r.row for r in documents.workbook_rows(files, batch=3).collect()) == [1] * 64 + [2] * 64
    assert documents.workbook_rows(files.limit(0)).count() == 0


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1"><v>4.5</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    (tmp_path / "a.xlsx").write_bytes(packed(**{"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst {ns}><si><t>x</t></si><si><r><t>sh</t></r><r><t>ared</t></r></si></sst>"}))
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    rows = documents.workbook_rows(documents.listing(spark, str(tmp_path), ("xlsx",)))
    assert sorted((r.row, r.cells) for r in rows.collect()) == [(1, ["shared", None, "4.5"]), (3, [None, "in"])]
    assert [tuple(r) for r in documents.fixed_columns(rows, {"a": 1, "c": 3}, first=2).collect()] == [(3, None, None)]


def test_grid_keeps_line_feeds(spark, tmp_path):
    (tmp_path / "s.csv").write_text('name,answer\nkim,"one\ntwo ""q"""\n')
    assert [tuple(r) for r in tables.grid(spark, str(tmp_path / "s.csv")).collect()][1] == ("kim", 'one\ntwo "q"')


def test_payloads(spark):
    texts = ['ok [{"results":[{"k":1},{"k":2}]},{"results":[]},{"results":[{"k":3}]}]', "none", "[broken", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    assert [(r.batch, r.pos, r.k) for r in tables.payload_rows(df, "p", "k int").collect()] == [(0, 0, 1), (0, 1, 2), (2, 0, 3)]


def test_nfc(spark):
    df = spark.createDataFrame([("é",), (None,)], "v string")
    assert [r[0] for r in df.select(documents.nfc(F.col("v"))).collect()] == ["é", None]


def test_seed_tables_keep_all_constraints(spark):
    made = seed.seed(spark)
    assert made["authors"].groupBy("cohort").count().orderBy("cohort").collect() == [(c, n) for c, n in seed.COHORTS.items()]
    assert schema.report(made).count() == 0
    answers = made["qna"].groupBy("author_id").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(answers) == (2, 5)
    assert made["evaluations"].count() == 429 + 69 + 92
    assert sorted(map(tuple, made["authors"].collect())) == sorted(map(tuple, seed.seed(spark)["authors"].collect()))


def test_report_finds_violations(spark):
    made = seed.seed(spark)
    bad = made["evaluations"].withColumn("total_score", F.when(F.col("total_score") == 100, 120).otherwise(F.col("total_score")))
    lost = made["qna"].withColumn("author_id", F.lit("gone"))
    got = {(r.table, r.rule) for r in schema.report({**made, "evaluations": bad, "qna": lost}).collect()}
    assert got == {("evaluations", "total_score"), ("qna", "author_id in authors")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "가"), (2, None)], "row long, message string")
    sinks.write_snapshot(df, str(tmp_path / "t"), "1")
    sinks.write_snapshot(sinks.read_snapshot(spark, str(tmp_path / "t"), "1").filter("row = 1"), str(tmp_path / "t"), "2")
    assert sinks.read_snapshot(spark, str(tmp_path / "t"), "2").count() == 1
    sinks.write_json(df, str(tmp_path / "j"))
    assert "가" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    out = str(tmp_path / "r")
    assert sinks.resume(df, out).count() == 2
    sinks.append_results(scoring.score(df.limit(1), lambda m: "{}", pause=0), out)
    assert [r.row for r in sinks.resume(df, out).collect()] == [2]
    back = sinks.write_back(df, spark.createDataFrame([(2, "set")], "row long, message string"), ["message"])
    assert {r.row: r.message for r in back.collect()} == {1: "가", 2: "set"}
    assert sinks.match_report(spark.createDataFrame([(1, "new"), (2, "new")], "i int, how string")).first().n == 2


def test_stream_takes_every_file_once(spark, tmp_path):
    schema_ = "row long, reply string"
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(2):
        spark.createDataFrame([(k, '{"가독성": 5}')], schema_).write.mode("append").parquet(source)
        intake.score_replies(intake.arriving(spark, source, schema_), target, state).awaitTermination()
    got = spark.read.parquet(target)
    assert sorted(r.row for r in got.collect()) == [0, 1]


def test_windows_and_first_seen(spark, tmp_path):
    source = str(tmp_path / "e")
    spark.createDataFrame([(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:02"), (2, "2024-01-01 00:11:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("t")).write.parquet(source)
    rows = intake.arriving(spark, source, "k int, t timestamp")
    for df, name, mode in ((intake.first_seen(rows, "k", "t"), "seen", "append"), (intake.counts_per_window(rows, "t", "10 minutes", "1 minute", "k"), "counted", "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert sorted(r.k for r in spark.table("seen").collect()) == [1, 2]
    assert sorted((r.k, r.n) for r in spark.table("counted").collect()) == [(1, 2), (2, 1)]


def test_bound_parameters(spark):
    spark.createDataFrame([(1, "a' OR 1=1"), (2, "b")], "id int, name string").createOrReplaceTempView("bound_rows")
    assert [r.id for r in tables.query(spark, "SELECT * FROM bound_rows WHERE name = ?", "a' OR 1=1").collect()] == [1]
    assert tables.query_one(spark, "SELECT * FROM bound_rows WHERE id > :low ORDER BY id", low=0).collect()[0].id == 1
    assert tables.query_one(spark, "SELECT * FROM bound_rows WHERE id > ?", 9).count() == 0
