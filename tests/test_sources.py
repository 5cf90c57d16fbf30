"""Readers on small files made here; pronunciation and English forms by literals."""

import gzip
import io
import json
import lzma
import tarfile
import zipfile

from pyspark.sql import functions as F

from lexispark.functions import english, phonology
from lexispark.sources import readers as R


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": "1", "url": "https://x.al:80/p", "text": "Një tekst"}) + "\n" + json.dumps({"id": "2"}) + "\n")
    row = R.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "r").collect()
    assert [(r["doc_id"], r["domain"], r["quality"], r["partition_id"]) for r in row] == [("1", "x.al", "good", "r#a_jsonl_gz")]
    (tmp_path / "b.conllu").write_text("# sent_id = s1\n# text = Po vjen.\n1\tPo\n\n# sent_id = s2\n# text = Jo.\n1\tJo\n\n")
    assert texts(R.read_conllu(spark, str(tmp_path / "b.conllu"), "r")) == [("s1", "Po vjen."), ("s2", "Jo.")]
    with lzma.open(tmp_path / "c.xz", "wt") as f:
        f.write("një\n\ndy\n")
    assert texts(R.read_xz_lines(spark, str(tmp_path / "c.xz"), "r")) == [("1", "një"), ("3", "dy")]
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("x.sq", "a\nb\n")
        z.writestr("x.en", "c\n")
    assert texts(R.read_moses_zip(spark, str(tmp_path / "d.zip"), "r")) == [("x.sq:1", "a"), ("x.sq:2", "b")]
    with tarfile.open(tmp_path / "e.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("k-sentences.txt")
        info.size = len(b"7\tshtate\n")
        t.addfile(info, io.BytesIO(b"7\tshtate\n"))
    assert texts(R.read_tar_sentences(spark, str(tmp_path / "e.tar.gz"), "r")) == [("7", "shtate")]
    line = "1\tsqi\tPo.\tx\n2\teng\tYes.\tx\n".encode()
    with tarfile.open(tmp_path / "f.tar.bz2", "w:bz2") as t:
        info = tarfile.TarInfo("sentences_detailed.csv")
        info.size = len(line)
        t.addfile(info, io.BytesIO(line))
    assert texts(R.read_tatoeba(spark, str(tmp_path / "f.tar.bz2"), "r")) == [("1", "Po.")]
    spark.createDataFrame([("a b c", ["x y z", "no"], {"k": "d e f"}, 1)], "s string, l array<string>, m map<string,string>, n int").write.parquet(str(tmp_path / "g"))
    assert sorted(t for _, t in texts(R.read_parquet_strings(spark, str(tmp_path / "g"), "r"))) == ["a b c", "d e f", "x y z"]
    (tmp_path / "h.xml").write_text("<m><page><title>A</title><ns>0</ns><id>1</id><revision><text x='1'>Tekst</text></revision></page><page><title>B</title><ns>1</ns><id>2</id></page></m>")
    assert texts(R.read_wiki(spark, str(tmp_path / "h.xml"), "r")) == [("1", "Tekst")]
    (tmp_path / "i.json").write_text(json.dumps({"targets": [{"id": "t", "targetKey": "k", "tokens": [" TË ", "", "Punoj"]}]}))
    assert R.read_targets(spark, str(tmp_path / "i.json")).first()["tokens"] == ["të", "punoj"]


def test_pronunciation(spark):
    assert [phonology.ipa(w) for w in ("punoj", "djeg", "do të punoja")] == ["puˈnɔj", "ˈdjɛɡ", "ˈdɔ ˈtə puˈnɔja"]
    assert phonology.ipa("është", {"është": 1}) == "əˈʃtə" and phonology.ipa("shtr") == "ʃtɾ"
    rows = phonology.pronounce(spark.createDataFrame([("punoj",), (None,), ("punoj",)], "form string"))
    assert sorted(str(r["ipa"]) for r in rows.collect()) == ["None", "puˈnɔj", "puˈnɔj"]


def test_english(spark):
    verbs = spark.createDataFrame([("to work",), ("to stop / to cease",), ("to carry",), ("to die",), ("to see",), ("to give up",), ("to make",), ("to play",), ("to visit",)], "translation_en string")
    irregular = spark.createDataFrame([("see", "saw", "seen", "seeing"), ("give", "gave", "given", "giving"), ("make", "made", "made", "making")], english.FORMS)
    found = {r["base"]: (r["past"], r["participle"], r["gerund"]) for r in english.english_forms(verbs, irregular).collect()}
    assert found == {
        "work": ("worked", "worked", "working"), "stop": ("stopped", "stopped", "stopping"), "carry": ("carried", "carried", "carrying"), "die": ("died", "died", "dying"), "see": ("saw", "seen", "seeing"),
        "give up": ("gave up", "given up", "giving up"), "make": ("made", "made", "making"), "play": ("played", "played", "playing"), "visit": ("visited", "visited", "visiting"),
    }


def test_streaming(spark):
    from lexispark.streaming.stats import windowed_counts

    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet("/root/testdata/sf0.001/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    query = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        query.processAllAvailable()
        assert spark.table("counts").agg(F.sum("n")).first()[0] == batch.count()
    finally:
        query.stop()


def test_archives_beyond_two_gigabytes(spark, tmp_path):
    """A zip of more bytes than a row can hold: its directory and members are read, by several tasks, and nothing else."""
    import io
    import zipfile

    from lexispark.sources import readers as R

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(40):
            z.writestr(f"m{k}.sq", f"line {k}\n\nsecond {k}\r\n")
        z.writestr("other.en", "no")
    folder = tmp_path / "zips"
    folder.mkdir()
    with open(folder / "large.zip", "wb") as f:
        f.seek(2_300_000_000)  # a hole before the archive takes no disk
        f.write(packed.getvalue())
    found = R.read_moses_zip(spark, f"file://{folder}", "r")
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert {(r["doc_id"], r["text"]) for r in rows} == {(f"m{k}.sq:{n}", f"{w} {k}") for k in range(40) for n, w in ((1, "line"), (3, "second"))}
    assert {r["partition_id"] for r in rows} == {"r#large_zip"} and len({r["task"] for r in rows}) > 1
    assert "content" not in R._files(spark, f"file://{folder}")._jdf.queryExecution().executedPlan().toString()


def test_streams_are_read_by_pieces(spark, tmp_path):
    """A tar whose members come one after the other from a stream, and xz lines of any length."""
    import io
    import lzma
    import tarfile

    from lexispark.sources import readers as R

    def add(t, name, data):
        info = tarfile.TarInfo(name)
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        add(t, "x/big.bin", bytes(3_000_000))
        add(t, "x/s-sentences.txt", "".join(f"{k}\ttext {k}\n" for k in range(5000)).encode() + b"no tab\n\n9\t \n")
    found = R.read_tar_sentences(spark, f"file://{tmp_path}/a.tar.gz", "r").collect()
    assert len(found) == 5000 and {(r["doc_id"], r["text"]) for r in found} == {(str(k), f"text {k}") for k in range(5000)}
    (tmp_path / "b.xz").write_bytes(lzma.compress(("x" * 2_000_000 + "\n \nshort\n").encode()))
    found = R.read_xz_lines(spark, f"file://{tmp_path}/b.xz", "r").collect()
    assert [(r["doc_id"], len(r["text"])) for r in found] == [("1", 2_000_000), ("3", 5)]


def test_files_grow_in_number(spark, monkeypatch):
    """Larger tables give more files, each of about one size, and readers give the same rows; lines are numbered through all files."""
    from lexispark.plans import files
    from lexispark.registry import queries

    sf = "/root/testdata/sf0.001"
    names = ("rd_txt_lines", "rd_moses_zip", "rd_xml_zip", "rd_wiki_bz2", "rd_tatoeba", "rd_xz_lines")
    before = {n: sorted(map(str, queries()[n](spark, sf).collect())) for n in names}
    assert files.parts(spark, sf) == files.PARTS
    monkeypatch.setattr(files, "PART_BYTES", 20_000)
    assert files.parts(spark, sf) > 2 * files.PARTS
    assert files._documents(spark, sf).rdd.getNumPartitions() == files.parts(spark, sf)
    for n in names:
        assert sorted(map(str, queries()[n](spark, sf).collect())) == before[n]


def test_directory_of_a_zip_is_read_once_in_a_task(tmp_path, monkeypatch):
    import zipfile

    from lexispark.sources import readers

    for k in "ab":
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            for i in range(50):
                z.writestr(f"{i}", f"{k}{i}")
    made = []

    class Counted(zipfile.ZipFile):
        def __init__(self, *a, **b):
            made.append(1)
            super().__init__(*a, **b)

    monkeypatch.setattr(zipfile, "ZipFile", Counted)
    run = readers._from_zips(lambda z, file, name: iter([(name, z.read(name).decode())]))
    found = [row for k in "ab" for i in range(50) for row in run(str(tmp_path / f"{k}.zip"), str(i))]
    assert found == [(str(i), f"{k}{i}") for k in "ab" for i in range(50)] and len(made) == 2
