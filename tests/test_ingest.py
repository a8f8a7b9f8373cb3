import datetime as dt
import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.functions.encoders import HashingEncoder, embed
from passagelake.functions import extract
from passagelake.functions.extract import docx_text
from passagelake.operators import guards, ids, quality
from passagelake.plans.ingest import explode_chunks, ingest
from passagelake.plans.registry import _docx_file
from passagelake.schema import TABLES
from passagelake.session import scratch_path
from passagelake.sources import files, sinks, tables
from passagelake.streaming import ingest as streaming
from passagelake.streaming.ingest import stream_ingest
from passagelake.streaming.metrics import replay, stream_upload_metrics, upload_metrics

def now():
    return F.lit(dt.datetime(2025, 1, 1, 8))

STORED = "collection_id int, title_document string"


def _counting():
    def factory():  # local, so that it travels to the workers by value
        return lambda texts: np.tile(np.arange(1024, dtype=np.float32), (len(texts), 1))

    return factory


counting_encoder = _counting()


def docx(spark, body):
    return bytes(spark.createDataFrame([(body,)], "x string").select(_docx_file(F.col("x"))).first()[0])


@pytest.fixture
def folder(spark, tmp_path):
    target = tmp_path / "up load"
    target.mkdir()
    contents = {
        "a file.txt": b"Rivers carve slow valleys. " * 20,
        "empty.txt": b"",
        "bad.txt": b"\xff\xfe",
        "page.HTML": b"<p>un</p><script>no</script><p>deux</p>",
        "letter.docx": docx(spark, "first line\nsecond"),
        "broken.docx": b"no archive",
        "paper.pdf": b"%PDF-1.4",
        "table.csv": b"a,b",
        "noext": b"x",
        "exact.txt": b"a " * (1_048_576 // 2),
        "large.txt": b"a" * 1_048_577,
    }
    for name, content in contents.items():
        (target / name).write_bytes(content)
    return str(target)


def as_uploads(found):
    name = F.regexp_replace(files.file_name(F.col("path")), "%20", " ")
    return found.select(
        F.xxhash64(name).alias("upload_id"), F.xxhash64(name).alias("arrival"), F.lit(2).alias("collection_id"),
        F.lit("my_Docs x").alias("collection_name"), name.alias("title"), name.alias("filename"),
        F.col("length").alias("size_bytes"), "content",
    )


def test_files_to_tables(spark, folder):
    found = files.scan_files(spark, folder, include_empty=True)
    assert found.count() == 11
    stored = spark.createDataFrame([], STORED)
    result = ingest(as_uploads(found), stored, now(), F.lit("me"), counting_encoder)
    documents = {r.title_document: r for r in result.documents.collect()}
    assert {k: v.num_of_chunks for k, v in documents.items()} == {
        "a-file.txt": 1, "empty.txt": 0, "page.HTML": 1, "letter.docx": 1, "exact.txt": 1311,
    }
    assert documents["a-file.txt"].minio_link == "/browser/collection-2-my-Docs-x/a-file.txt"
    assert documents["a-file.txt"].posted_by == "me" and documents["a-file.txt"].date_de_creation == dt.date(2025, 1, 1)
    reasons = {r.title_document: r.reason for r in result.quarantine.collect()}
    assert reasons == {
        "bad.txt": "invalid_utf8", "broken.docx": "unreadable_docx", "paper.pdf": "no_pdf_decoder",
        "table.csv": "bad_extension", "noext": "bad_extension", "large.txt": "too_large",
    }
    chunks = {(r.document_id, r.chunk_index): r for r in result.chunks.collect()}
    assert len(chunks) == 1314
    first = chunks[documents["a-file.txt"].document_id, 0]
    assert first.chunk_text == ("Rivers carve slow valleys. " * 20).strip() and first.taille_chunk == len(first.chunk_text)
    assert first.embedding == list(range(1024))
    assert chunks[documents["page.HTML"].document_id, 0].chunk_text == "un deux"
    assert chunks[documents["letter.docx"].document_id, 0].chunk_text == "first line second"


def test_docx_layout_breaks_give_no_text():
    body = (
        '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r>'
        '<w:t>ab</w:t><w:br w:type="page"/><w:t>cd</w:t><w:br w:type="column"/><w:ptab/><w:t>ef</w:t><w:br/><w:t>gh</w:t>'
        "</w:r></w:p></w:body></w:document>"
    )
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w") as archive:
        archive.writestr("word/document.xml", body)
    assert extract.paragraph_texts(target.getvalue()) == ["abcd\tef\ngh"]


def test_pdf_through_a_given_decoder(spark, folder):
    found = files.scan_files(spark, folder, glob="*.pdf")
    result = ingest(
        as_uploads(found), spark.createDataFrame([], STORED), now(), F.lit("me"), pdf_decoder=lambda b: "from " + b[:4].decode()
    )
    assert result.chunks.first().chunk_text == "from %PDF" and result.quarantine.count() == 0


def test_large_files_are_not_opened(spark, folder):
    found = files.scan_files(spark, folder, max_bytes=1_048_576)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1048576)" in plan
    assert {r.length for r in files.oversized_files(spark, folder).collect()} == {1_048_577}
    manifest = files.object_manifest(spark, folder)
    assert "content" not in manifest._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert manifest.filter("object_name = 'noext'").first().size_bytes == 1


def test_docx_paragraphs_only():
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = (
        f"<w:document {w}><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        "<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:p/></w:body></w:document>"
    )
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w") as archive:
        archive.writestr("word/document.xml", body)
    assert docx_text(target.getvalue()) == "a\tb link  "


def simulate(uploads, stored):
    """One request after another."""
    taken, out = set(stored), {}
    for uid, collection, name, size, _ in sorted(uploads, key=lambda u: (u[4], u[0])):
        title = name.replace(" ", "-")
        if (collection, title) in taken:
            out[uid] = "duplicate"
        elif title.split(".")[-1].lower() not in {"pdf", "txt", "html", "docx"}:
            out[uid] = "bad_extension"
        elif size > 1_048_576:
            out[uid] = "too_large"
        else:
            out[uid] = "accepted"
            taken.add((collection, title))
    return out


@pytest.mark.parametrize("small_batch", [False, True])
def test_gates_equal_one_by_one(spark, small_batch):
    rng = np.random.default_rng(7)
    uploads = [
        (i, int(rng.integers(1, 3)), "hot file.txt" if i % 3 == 0 else f"f {rng.integers(9)}.{['txt', 'csv', 'PDF'][rng.integers(3)]}",
         int(rng.choice([10, 1_048_576, 1_048_577])), int(rng.integers(0, 40)))
        for i in range(300)
    ]
    stored = [(1, "f-1.txt"), (1, "f-1.txt"), (2, "f-2.csv"), (2, "other.txt")]
    df = spark.createDataFrame(uploads, "upload_id long, collection_id int, filename string, size_bytes long, arrival long")
    got = guards.upload_gate_outcome(df, spark.createDataFrame(stored, STORED), small_batch)
    assert {r.upload_id: r.outcome for r in got.collect()} == simulate(uploads, stored)


def test_chunk_keys_and_ids(spark):
    texts = spark.createDataFrame([(i, "w " * (i * 150)) for i in range(30)], "document_id long, text string")
    cut = explode_chunks(texts)
    numbered = ids.assign_ids(cut, ["document_id", "chunk_index"], "chunk_id", after=41)
    got = sorted(r.chunk_id for r in numbered.collect())
    assert got == list(range(42, 42 + len(got))) and len(got) == sum(-(-i * 150 // 400) for i in range(30))
    shuffled = ids.assign_ids(cut.repartition(7), ["document_id", "chunk_index"], "chunk_id", after=41)
    assert numbered.exceptAll(shuffled.select(numbered.columns)).count() == 0


def test_hashing_encoder_counts_words(spark):
    encode = HashingEncoder(16)()
    a, b, c = encode(["x y", "x  y", ""])
    assert (a == b).all() and not c.any() and (encode(["x x"])[0] == 2 * encode(["x"])[0]).all()
    got = spark.createDataFrame([("x y",), (None,), ("",)], "t string").coalesce(1).select(embed(F.col("t"), HashingEncoder(16)).alias("v"))
    values = [r.v for r in got.collect()]
    assert values == [list(a), None, [0.0] * 16]


def test_encoder_of_wrong_shape_fails(spark):
    def wrong():
        return lambda texts: np.zeros(len(texts))

    with pytest.raises(Exception, match="encoder returned shape"):
        spark.createDataFrame([("x",)], "t string").select(embed(F.col("t"), wrong)).collect()


def test_sinks_round_trip(spark, folder):
    root = scratch_path(spark, "t")
    result = ingest(as_uploads(files.scan_files(spark, folder)), spark.createDataFrame([], STORED), now(), F.lit("me"))
    for _ in range(2):  # a repeated batch replaces itself
        sinks.sink_documents_chunks(result.documents, result.chunks, root, "bulk", 0)
    assert spark.read.parquet(f"{root}/documents").count() == 5
    assert spark.read.parquet(f"{root}/chunks").count() == 1314
    documents = tables.read(spark, root, "documents")
    assert documents.columns == TABLES["documents"].names and documents.count() == 5
    assert quality.stored_chunk_count_check(documents, tables.read(spark, root, "chunks")).count() == 0


def test_constraint_report_needs_declared_columns(spark):
    with pytest.raises(ValueError, match="lacks columns"):
        quality.constraint_violations(spark.range(1), "users")


def run_stream(spark, folder, root, **options):
    stream_ingest(
        spark, folder, root, f"{root}/_checkpoint", as_uploads, now(), F.lit("me"), counting_encoder, **options
    ).awaitTermination()


def test_stream_equals_batch_and_restarts(spark, folder):
    root = scratch_path(spark, "stream")
    run_stream(spark, folder, root, files_per_batch=4)
    batch = ingest(as_uploads(files.scan_files(spark, folder, include_empty=False)), spark.createDataFrame([], STORED), now(), F.lit("me"), counting_encoder)
    key = ["title_document", "num_of_chunks", "minio_link"]
    read = lambda: sorted(map(tuple, spark.read.parquet(f"{root}/documents").select(key).collect()))
    assert read() == sorted(map(tuple, batch.documents.select(key).collect()))
    run_stream(spark, folder, root, files_per_batch=4)  # nothing new
    assert len(read()) == 4
    os.makedirs(f"{folder}/later")
    for name, body in (("new.txt", b"one two"), ("a file.txt", b"again")):
        with open(f"{folder}/later/{name}", "wb") as target:
            target.write(body)
    run_stream(spark, folder, root, files_per_batch=4)
    assert [r for r in read() if r[0] == "new.txt"] == [("new.txt", 1, "/browser/collection-2-my-Docs-x/new.txt")]
    assert len(read()) == 5
    reasons = [r.reason for r in spark.read.parquet(f"{root}/quarantine").collect()]
    assert reasons.count("duplicate") == 1


def test_new_checkpoint_and_bulk_ingest_add_to_a_root(spark, tmp_path):
    root = scratch_path(spark, "shared-root")
    folders = []
    for n in range(2):
        folders.append(str(tmp_path / f"arrivals{n}"))
        os.makedirs(folders[-1])
        for name, body in ((f"own{n}.txt", b"a b c"), ("common.txt", b"d e")):
            with open(f"{folders[-1]}/{name}", "wb") as target:
                target.write(body)
    bulk = ingest(as_uploads(files.scan_files(spark, folders[0])), spark.createDataFrame([], STORED), now(), F.lit("me"), counting_encoder)
    sinks.sink_documents_chunks(bulk.documents, bulk.chunks, root, "bulk", 0)
    for n in range(2):
        stream_ingest(
            spark, folders[n], root, f"{root}/_checkpoint{n}", as_uploads, now(), F.lit("me"), counting_encoder
        ).awaitTermination()
    titles = [r.title_document for r in spark.read.parquet(f"{root}/documents").collect()]
    assert sorted(titles) == ["common.txt", "own0.txt", "own1.txt"]
    reasons = [r.reason for r in spark.read.parquet(f"{root}/quarantine").collect()]
    assert reasons == ["duplicate"] * 3


def put(spark, root, run_id, batch_id, names):
    rows = spark.createDataFrame([(1, name) for name in names], STORED)
    rows.write.mode("overwrite").parquet(f"{root}/documents/run_id={run_id}/batch_id={batch_id}")


def test_a_batch_reads_few_folders(spark, monkeypatch):
    """However many batches were stored, one reads the gathered keys and a bounded number of folders."""
    monkeypatch.setattr(streaming, "RECENT_FOLDERS", 3)
    root = scratch_path(spark, "keys")
    stored, read = streaming.StoredKeys(root), []
    titles = lambda batch: sorted(r.title_document for r in stored.before(spark, "own", batch).collect())
    monkeypatch.setattr(
        streaming.StoredKeys, "_read", lambda self, spark, folders, was=streaming.StoredKeys._read: read.append(len(folders)) or was(self, spark, folders)
    )
    assert titles(0) == []
    for batch in range(12):
        put(spark, root, "own", batch, [f"own{batch}"])
        assert titles(batch + 1) == sorted(f"own{i}" for i in range(batch + 1))
    assert max(read) == 4
    put(spark, root, "own", 13, ["failed try"])
    put(spark, root, "other", 0, ["other0"])  # another run is seen in the next batch
    assert titles(13) == sorted([f"own{i}" for i in range(12)] + ["other0"])
    put(spark, root, "own", 0, ["instead"])  # a folder that was gathered has changed
    assert titles(13) == sorted([f"own{i}" for i in range(1, 12)] + ["instead", "other0"])


def test_folders_are_listed_with_their_times(spark):
    root = scratch_path(spark, "listed")
    stored = streaming.StoredKeys(root)
    assert stored._folders(spark) == []
    for run, batch in (("a", 0), ("a", 11), ("b", 3)):
        put(spark, root, run, batch, ["x"])
    listed = stored._folders(spark)
    assert sorted(name for name, _ in listed) == ["run_id=a/batch_id=0", "run_id=a/batch_id=11", "run_id=b/batch_id=3"]
    path = lambda name: f"{root}/documents/{name}".removeprefix("file:")
    assert all(changed == int(os.stat(path(name)).st_mtime * 1000) for name, changed in listed)
    os.makedirs(path("run_id=a/_other"))  # what has no batch in its name makes the listing go one by one
    assert sorted(stored._folders(spark)) == sorted(listed)


def test_a_small_batch_reads_its_files_twice(spark, folder, tmp_path):
    """Once for names and sizes, once for the texts; neither guards nor rejects read them again."""
    opened = tmp_path / "opened"
    opened.mkdir()

    @F.udf("binary")
    def seen(path, content):
        with open(opened / str(hash(path)), "a") as target:
            target.write("x")
        return content

    uploads = as_uploads(files.scan_files(spark, folder, include_empty=False).withColumn("content", seen.asNondeterministic()("path", "content")))
    scanned = spark.createDataFrame(uploads.rdd, uploads.schema)  # as in a stream, every scan reads the contents
    result = ingest(scanned, spark.createDataFrame([(2, "a-file.txt")], STORED), now(), F.lit("me"), counting_encoder, small_batch=True)
    reasons = {r.title_document: r.reason for r in result.quarantine.collect()}
    assert reasons["a-file.txt"] == "duplicate" and reasons["large.txt"] == "too_large" and reasons["bad.txt"] == "invalid_utf8"
    assert result.documents.count() == 3 and result.chunks.count() == 1313
    assert {len(p.read_text()) for p in opened.iterdir()} == {2}


def test_a_batch_stores_few_files(spark, tmp_path):
    """However many tasks the size of a file split gives, narrow rows of a batch make one file, texts one for each core."""
    arrivals, root = tmp_path / "arrivals", scratch_path(spark, "few-files")
    arrivals.mkdir()
    for i in range(60):
        (arrivals / f"f{i}.{'csv' if i % 10 == 0 else 'txt'}").write_text(f"text {i}")
    scratch = os.path.dirname(root.removeprefix("file:"))
    extracted = lambda: {f for f in os.listdir(scratch) if f.startswith(("extracted-", "names-"))}
    there, split = extracted(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a task for each file
    try:
        run_stream(spark, str(arrivals), root, files_per_batch=30)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    parts = lambda folder: sum(f.endswith(".parquet") for _, _, names in os.walk(folder) for f in names)
    for name, rows in (("documents", 54), ("quarantine", 6)):
        assert spark.read.parquet(f"{root}/{name}").count() == rows
        assert parts(f"{root}/{name}".removeprefix("file:")) == 2
    made = extracted() - there
    assert len(made) == 2 and all(parts(f"{scratch}/{f}") <= spark.sparkContext.defaultParallelism + 1 for f in made)


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_metrics_equal_batch_for_closed_windows(spark, parts):
    path = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{path}/events.parquet")
    root = scratch_path(spark, "metrics")
    if parts > 1:  # a table as a folder of part files
        path = scratch_path(spark, "parts")
        events.repartition(parts).write.parquet(f"{path}/events.parquet")
    stream = replay(spark, events.schema, f"{path}/events.parquet")
    stream_upload_metrics(stream, root, root + "-c").awaitTermination()
    columns = ["window_start", "n_uploads", "le_10_0"]
    cast = lambda df: {tuple(map(str, r)) for r in df.select(columns).collect()}
    closed = cast(spark.read.parquet(root))
    assert closed and closed <= cast(upload_metrics(events.withColumn("ts", F.col("ts").cast("timestamp"))))
