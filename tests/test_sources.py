import pytest
from pyspark.sql import functions as F

from clustrum.functions.edit import Costs
from clustrum.plans.api import Clusterer
from clustrum.sources import text, vectors


def write(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def test_plain_sequences_in_order(spark, tmp_path):
    a = write(tmp_path, "a.txt", "one \n\n# no\ntwo words\nà")
    b = write(tmp_path, "b.txt", "last\n")
    got = [(r["id"], r["s"]) for r in text.read_sequences(spark, [a, b]).orderBy("id").collect()]
    assert got == [(0, "one"), (1, "two words"), (2, "à"), (3, "last")]


def test_fasta(spark, tmp_path):
    a = write(tmp_path, "a.fa", ">Gene 1\nacgt\nAC\n\n>Gene 2\nTT\n")
    b = write(tmp_path, "b.fa", ">Gene 3\nGGG")
    got = [(r["id"], r["name"], r["s"]) for r in text.read_sequences(spark, [a, b]).orderBy("id").collect()]
    assert got == [(0, "Gene 1", "ACGTAC"), (1, "Gene 2", "TT"), (2, "Gene 3", "GGG")]


@pytest.mark.parametrize("content", [">a\n\nAC\n", ">a\n>b\nAC\n", ">\nAC\n", ">a\nAC\n\nGT\n", ">a\nA C\n", ">a\nAC\n>b\n", "AC\n>a\nAC\n"])
def test_bad_fasta(spark, tmp_path, content):
    with pytest.raises(ValueError):
        text.read_sequences(spark, [write(tmp_path, "x.fa", content)]).collect()


def test_cost_files(spark, tmp_path):
    assert text.read_costs(spark, write(tmp_path, "c", "# c\n* 2.0\n* * 3.0\n")) == Costs(2.0, 3.0)
    t = text.read_costs(spark, write(tmp_path, "t", "A 1\nC 2\nA C 1.5\n"))
    assert t.indel == {"A": 1.0, "C": 2.0} and t.switch == {("A", "C"): 1.5, ("C", "A"): 1.5}


@pytest.mark.parametrize("content", ["", "* 1\n", "A 1 2 3\nC 1\n", "AB 1\nC 1\n", "A A 1\nC 1\n", "A C 1\nC A 2\n", "A 1\nA 2\n", "* 1\n* 2\n"])
def test_bad_cost_files(spark, tmp_path, content):
    with pytest.raises(ValueError):
        text.read_costs(spark, write(tmp_path, "c", content))


def test_alphabet_and_codes(spark):
    df = spark.createDataFrame([(0, "cab"), (1, "bd")], "id long, s string")
    assert [(r["symbol"], r["code"]) for r in text.alphabet(df).orderBy("code").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert {r["id"]: r["codes"] for r in text.recoded(df).collect()} == {0: [2, 0, 1], 1: [1, 3]}
    assert text.missing_costs(df, Costs({"a": 1.0}, {("a", "b"): 1.0})) == ["indel b", "indel c", "indel d", "switch a c", "switch a d", "switch b c", "switch b d", "switch c d"]


def test_words_end_to_end(spark, tmp_path):
    words = write(tmp_path, "w.txt", "aaaa\naaab\naaba\nzzzz\nzzzy\nzzyz\n")
    costs = write(tmp_path, "c.txt", "* 1.0\n* * 1.0\n")
    out = str(tmp_path / "out")
    r = Clusterer(K=2, metric="levenshtein", energy="identity", init="kmeans++", max_rounds=5, max_proposals=30, max_time=1e6, patient=False, level=0).text(spark, [words], costs, out)
    k = {q["id"]: q["k"] for q in r.labels.collect()}
    assert k[0] == k[1] == k[2] != k[3] == k[4] == k[5]
    lines = sorted(x["value"] for x in spark.read.text(out).collect())
    assert len(lines) == 6 and lines[0].startswith("aaaa\t : ")


def test_invalid_cost_tables_are_rejected(spark, tmp_path):
    seqs = write(tmp_path, "s.txt", "AC\nCA\nAA\n")
    costs = write(tmp_path, "c.txt", "A 1\nC 1\nA C 5\n")
    with pytest.raises(ValueError, match="two indels"):
        Clusterer(K=1, metric="levenshtein").text(spark, [seqs], costs)


def test_vector_sources(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 3], [2.0, 4.0]), (1, [2], [1.0])], "id long, i array<bigint>, v array<double>")
    assert {r["id"]: r["x"] for r in vectors.sparse(df, "id", "i", "v").collect()} == {0: {1: 2.0, 3: 4.0}, 1: {2: 1.0}}
    bad = spark.createDataFrame([(0, [1], [2.0, 4.0])], "id long, i array<bigint>, v array<double>")
    with pytest.raises(Exception, match="differ in length"):
        vectors.sparse(bad, "id", "i", "v").collect()
    path = write(tmp_path, "t.csv", "name,a,b\nx,1,?\ny,2,3\n")
    assert sorted(r["x"] for r in vectors.read_table(spark, path).collect()) == [[1.0, 0.0], [2.0, 3.0]]
    path = write(tmp_path, "s.txt", "1 3:1.5 7:2\n-1 2:4\n")
    assert sorted(map(str, (r["x"] for r in vectors.read_indexed(spark, path).collect()))) == ["{2: 4.0}", "{3: 1.5, 7: 2.0}"]
    long = df.select("id", F.explode("i").alias("i"))
    assert vectors.sparse_long(long, F.col("id"), F.col("i"), F.lit(1.0)).count() == 2
    assert len(vectors.projected(spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "id long, x array<double>"), 2).first()["x"]) == 2


def test_images_joins_and_scales(spark, tmp_path):
    (tmp_path / "img").write_bytes(bytes([0, 0, 8, 3, 0, 0, 0, 2, 0, 0, 0, 1, 0, 0, 0, 3, 1, 2, 255, 0, 128, 7]))
    x = vectors.read_images(spark, str(tmp_path / "img"))
    assert {r["id"]: r["x"] for r in x.collect()} == {0: [1.0, 2.0, 255.0], 1: [0.0, 128.0, 7.0]}
    both = vectors.concatenated(x, vectors.scaled(x, 2.0, 0.5, 1.0))
    assert {r["id"]: r["x"] for r in both.collect()}[1] == [0.0, 128.0, 7.0, 0.0, 64.0, 7.0]


def test_round_log(spark):
    df = spark.createDataFrame([("R=0  mE=1.5  Tp=3",), ("other",), ("R=1\tmE=- nprops=4",)], "text string")
    assert sorted((r["r"], r["mE"]) for r in text.round_log(df).collect()) == [(0, 1.5), (1, -1.0)]


def test_lines_over_many_splits_and_chunks(spark, tmp_path, monkeypatch):
    lines = [f"line {i}" + " " * (i % 3) + "x" * (i % 7) for i in range(500)]
    a, b = write(tmp_path, "a.txt", "\n".join(lines) + "\n"), tmp_path / "b.txt"
    b.write_bytes("\r\n".join(lines[:50]).encode())
    monkeypatch.setattr(text, "CHUNK", 7)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        got = [(r["file"], r["line"], r["text"]) for r in text.numbered_lines(spark, [a, str(b)]).orderBy("file", "line").collect()]
        assert got == [(0, i, s.rstrip(" ")) for i, s in enumerate(lines)] + [(1, i, s.rstrip(" ")) for i, s in enumerate(lines[:50])]
        assert text.numbered_lines(spark, [a]).rdd.getNumPartitions() > 10
        seqs = text.read_sequences(spark, [str(b), a]).orderBy("id").collect()
        assert [(r["id"], r["s"]) for r in seqs] == list(enumerate(s.rstrip(" ") for s in lines[:50] + lines))
        fasta = write(tmp_path, "c.fa", "".join(f">g{i}\n" + "ac\n" * (i % 9 + 1) + "\n" * (i % 2) + "# no\n" for i in range(60)))
        got = text.read_sequences(spark, [fasta, fasta]).orderBy("id").collect()
        assert [(r["id"], r["name"], r["s"]) for r in got] == [(i, f"g{i % 60}", "AC" * (i % 60 % 9 + 1)) for i in range(120)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])


def test_vector_files_over_many_splits(spark, tmp_path):
    table = write(tmp_path, "t.csv", "name,a,b\n" + "".join(f"n{i},{i},?\n" for i in range(200)))
    indexed = write(tmp_path, "i.txt", "\n".join(f"1 0:{i} 5:2" for i in range(200)) + "\n\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        assert [(r["id"], r["x"]) for r in vectors.read_table(spark, table).orderBy("id").collect()] == [(i, [float(i), 0.0]) for i in range(200)]
        assert [(r["id"], r["x"]) for r in vectors.read_indexed(spark, indexed).orderBy("id").collect()] == [(i, {0: float(i), 5: 2.0}) for i in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
