"""Readers on small files; writers by round trip."""

import gzip

import pytest

from helixframe.sinks import text as out
from helixframe.sources import lines, sequences, tables


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_fasta_round_trip_and_filters(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">one x y\nACGT\nAC GT\n>two\n\nAAAA\n>three\n")
    rows = sequences.fasta(spark, path).orderBy("ord").collect()
    assert [(r.name, r.seq) for r in rows] == [("one x y", "ACGTACGT"), ("two", "AAAA"), ("three", "")]
    out.write(sequences.fasta(spark, path), out.fasta_text(4), str(tmp_path / "b"), order=["ord"])
    assert {(r.name, r.seq) for r in sequences.fasta(spark, str(tmp_path / "b")).collect()} == {(r.name, r.seq) for r in rows}
    found = sequences.read_sequences(spark, path + "~~name~~lengthatleast:4~~select:one,three").collect()
    assert [(r.name, r.qual) for r in found] == [("one", None)]
    with pytest.raises(Exception, match="without a name"):
        sequences.fasta(spark, put(tmp_path, "c.fa", ">\nACGT\n")).collect()


def test_genbank(spark, tmp_path):
    path = put(tmp_path, "a.gb", "LOCUS       L1   10 bp\nACCESSION   A1\nVERSION     A1.2\nFEATURES\n     gene            1..5\nORIGIN\n        1 acgtacgtac\n       11 gt\n//\nLOCUS       L2   4 bp\nORIGIN\n        1 ttaa\n//\n")
    assert sorted((r.name, r.seq) for r in sequences.read_sequences(spark, path).collect()) == [("A1.2", "ACGTACGTACGT"), ("L2", "TTAA")]


def test_fastq_split_over_tasks(spark, tmp_path):
    records = [(f"r{k}", "ACGT" * (k % 5 + 1), "@+>I" * (k % 5 + 1)) for k in range(3000)]
    path = put(tmp_path, "a.fq", "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        found = sequences.fastq(spark, path).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r.name, r.seq, r.qual) for r in found] == records
    out.write(sequences.fastq(spark, path), out.fastq_text(), str(tmp_path / "b"), "gzip", ["ord"])
    assert sequences.fastq(spark, str(tmp_path / "b")).count() == 3000
    with pytest.raises(Exception, match="not a FASTQ record"):
        sequences.fastq(spark, put(tmp_path, "bad.fq", "@a\nAC\n+\nIII\n")).collect()


def test_sniff(spark, tmp_path):
    (tmp_path / "z.gz").write_bytes(gzip.compress(b"@r\nA\n+\nI\n"))
    cases = {"a": (">x\nA\n", "fasta"), "b": ("@r\nA\n+\nI\n", "fastq"), "c": ("##fileformat=VCFv4.1\n", "vcf"), "d": ("", "empty"), "e": ("c\ts\tt\t1\t2\t.\t+\t.\tID=1\n", "gff"), "f": ("@SQ\tSN:x\tLN:5\n", "sam"), "g": ("hello\n", "text")}
    assert {k: lines.sniff(spark, put(tmp_path, k, t)) for k, (t, _) in cases.items()} == {k: kind for k, (_, kind) in cases.items()}
    assert lines.sniff(spark, str(tmp_path / "z.gz")) == "fastq"


def test_sam(spark, tmp_path):
    path = put(tmp_path, "a.sam", "@HD\tVN:1.0\n@SQ\tSN:c:1\tLN:90\nr1\t16\tc\t5\t30\t3M1D2M\t=\t9\t0\tACGTA\tIIIII\tAS:i:12\tNM:i:0\n")
    row = tables.sam(spark, path).first()
    assert (row.qname, row.flag, row.pos, row.cigar, row.tags) == ("r1", 16, 5, "3M1D2M", ["AS:i:12", "NM:i:0"])
    assert tuple(tables.reference_lengths(spark, path).first()) == ("c:1", 90)


def test_gff_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.gff", "##gff-version 3\nc1\ts\tgene\t10\t20\t.\t+\t.\tID=g1;Note=a%3Bb+c\nc1\ts\tCDS\t11\t19\t2.5\t-\t0\tParent=g1,gone\n##FASTA\n>c1\nACGT\nAC\n>c2\nTT\n")
    found = tables.annotations(spark, path)
    rows = found.orderBy("s0").collect()
    assert [(r.s0, r.e0, r.strand, r.attr) for r in rows] == [(9, 20, 1, {"ID": "g1", "Note": "a;b+c"}), (10, 19, -1, {"Parent": "g1,gone"})]
    out.write_gff(found, str(tmp_path / "b"))
    assert tables.annotations(spark, str(tmp_path / "b")).orderBy("s0").collect() == rows
    assert [tuple(r) for r in tables.children(found).collect()] == [("g1", "CDS:c1-10..19")]
    assert sorted((r.name, r.seq) for r in sequences.gff_sequences(spark, path).collect()) == [("c1", "ACGTAC"), ("c2", "TT")]
    gtf = put(tmp_path, "a.gtf", 'c1\ts\texon\t1\t5\t.\t.\t.\tgene_id "x y"; n "2";\n')
    assert tables.annotations(spark, gtf).first().attr == {"gene_id": "x y", "n": "2"}


def test_vcf(spark, tmp_path):
    path = put(tmp_path, "a.vcf", "##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nc\t7\t.\tA\tC,G\t30.5\t.\tDP=4;EFF=x=y;FLAG\tGT:RO:AO\t0/1:5:3,1\t.:.:.\n")
    row = tables.vcf(spark, path).first()
    assert (row.pos, row.alt, row.qual, row.info) == (7, ["C", "G"], 30.5, {"DP": "4", "EFF": "x=y", "FLAG": ""})
    assert row.samples["s1"] == {"GT": "0/1", "RO": "5", "AO": "3,1"} and row.samples["s2"]["GT"] == "."
    line = tables.vcf(spark, path).select(out.vcf_line().alias("x")).first().x
    assert line == "c\t7\t.\tA\tC,G\t30.5\t.\tDP=4;EFF=x=y;FLAG"


def test_plots_tables_and_logs(spark, tmp_path):
    runs = spark.createDataFrame([(1, 3, 5), (4, 5, 2)], "start bigint, end bigint, depth bigint")
    out.write_plot(runs, 6, str(tmp_path / "plot"))
    assert [r.value for r in out.plot_values(runs, 6).orderBy("pos").collect()] == [0, 5, 5, 0, 2, 0]
    assert sum(r.forward for r in tables.userplot(spark, str(tmp_path / "plot")).collect()) == 12
    path = put(tmp_path, "p", "# BASE forward reverse\n1 4 5\n3 1 0\n")
    assert sorted((r.pos, r.forward, r.reverse) for r in tables.userplot(spark, path).collect()) == [(0, 4, 5), (2, 1, 0)]
    tidy = spark.createDataFrame([("f1", "Count", "a", "1"), ("f1", "Count", "b", "2"), ("f2", "Note", "n", "x")], "name string, grp string, col string, value string")
    out.grouped_csv(tidy, str(tmp_path / "t"), [("Count", "a"), ("Count", "b"), ("Note", "n")], ["sampleTags=a,b"])
    back = tables.grouped_table(spark, str(tmp_path / "t")).where("value is not null")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in tidy.collect()}
    log = put(tmp_path, "log", "x\n(> s1 1,234 reads kept\n")
    assert tuple(tables.datums(spark, log).first()) == ("s1", "1234", "reads kept")
    ev = put(tmp_path, "ev", "Position\ta\tb\tReference\tc\td\te\tf\n1\t-x3\tAx4\tA\t-\tA\t\t\n")
    assert {(r.is_insertion, r.evidence, r.call) for r in tables.evidence_table(spark, ev).collect()} == {(True, "-x3", "-"), (False, "Ax4", "A")}
