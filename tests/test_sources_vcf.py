from __future__ import annotations

import json

import cohorts
import pytest
from pyspark.sql import functions as F

from cohortgate.functions import genotype
from cohortgate.plans.driver_views import DEPLOYMENT
from cohortgate.sources import tables, vcf

SITES = "cpra string, chrom string, pos bigint, ref string, alt string"


def site(cpra):
    chrom, pos, ref, alt = cpra.split(":")
    return cpra, chrom, int(pos), ref, alt


def test_gt_codes(spark):
    cases = {"0/0": 0, "0|1": 1, "1/1": 2, "./.": -1, "./1": -1, ".": -1, "0/2": 2, "1": 1}
    frame = cohorts.table(spark, [(t,) for t in cases], "gt string")
    assert {r["gt"]: r["c"] for r in frame.select("gt", genotype.gt_code(F.col("gt")).alias("c")).collect()} == cases
    exact = {r["gt"]: r["c"] for r in frame.select("gt", genotype.gt_text_code(F.col("gt")).alias("c")).collect()}
    assert exact["0|1"] is None and exact["0/2"] is None and exact["1/1"] == 2


@pytest.mark.parametrize(("per_block", "region_bases"), [(100, None), (4, None), (4, 60)])
def test_pvcf_round_trip_on_disk(spark, tmp_path, per_block, region_bases):
    """Written gzip files read back give the same calls, also when samples span blocks."""
    cpras = ["2:50:A:G", "10:100:C:T", "X:7:G:A"]
    calls = [
        cohorts.array_call(f"P{i}", (i * j) % 4 - 1, cpra=c)
        for i in range(11) for j, c in enumerate(cpras, 1) if (i + j) % 3
    ] + [
        cohorts.imputed_call(f"P{i}", round(0.1 * i, 3), 0.9, c) for i in range(11) for c in cpras[:2]
    ]
    from cohortgate import schemas

    genotypes = cohorts.table(spark, calls, schemas.GENOTYPES)
    sites = cohorts.table(spark, [site(c) for c in cpras], SITES)
    meta = vcf.meta_lines("VCFv4.1", ["2", "10", "X"], [vcf.GT_DECLARATION])
    vcf.write_pvcf(*vcf.array_export(genotypes, sites, per_block), meta, f"{tmp_path}/array",
                   region_bases=region_bases)
    vcf.write_pvcf(*vcf.imputed_export(genotypes, sites, per_block), meta, f"{tmp_path}/imputed")
    lines = vcf.read_lines(spark, f"{tmp_path}/array/*/*/*.gz")
    order = [v.split("\t")[2] for v in (r["value"] for r in lines.collect()) if not v.startswith("#")]
    assert region_bases or order[:3] == cpras
    got = {
        (r["participant_id"], r["cpra"]): r["gt_code"]
        for r in vcf.parse_array(lines, None, allow_full_scan=True).collect()
    }
    want = {(c[0], c[1]): c[3] for c in calls if c[2] == "array"}
    assert {k: v for k, v in got.items() if k in want} == want
    assert all(v == -1 for k, v in got.items() if k not in want)
    assert len(got) == len({k[0] for k in want}) * 3
    imputed = vcf.parse_imputed(
        vcf.read_lines(spark, f"{tmp_path}/imputed/*/*/*.gz"),
        cohorts.table(spark, [("10:100:C:T",)], "cpra string"),
    ).collect()
    assert {r["cpra"] for r in imputed} == {"10:100:C:T"} and {r["max_gp"] for r in imputed} == {0.9}
    with pytest.raises(ValueError, match="full scan"):
        vcf.parse_array(lines, None)


def test_array_call_without_a_code_keeps_its_place(spark):
    """A call with no code, or with one that has no text, is absent and does not move the samples behind it."""
    from cohortgate import schemas

    codes = [("A", 0.0), ("B", None), ("C", 2.0), ("D", 3.0), ("E", float("nan")), ("F", 1.0)]
    calls = [(name, "2:50:A:G", "array", code, 40.0, 0.99, None, None) for name, code in codes]
    sites = cohorts.table(spark, [site("2:50:A:G")], SITES)
    _, data = vcf.array_export(cohorts.table(spark, calls, schemas.GENOTYPES), sites)
    [line] = data.collect()
    assert line["value"].split("\t")[9:] == ["0/0", "./.", "1/1", "./.", "./.", "0/1"]


def test_imputed_call_without_dosage_or_probability(spark):
    """What a call lacks is that of a sample without a call: no carrier is made of it, and GP keeps three entries."""
    from cohortgate import schemas

    given = [("A", None, None), ("B", 1.0, 0.9), ("C", None, 0.9), ("D", float("nan"), float("nan")), ("E", 1.0, None)]
    calls = [(name, "2:50:A:G", "imputed", None, None, None, dosage, max_gp) for name, dosage, max_gp in given]
    sites = cohorts.table(spark, [site("2:50:A:G")], SITES)
    _, data = vcf.imputed_export(cohorts.table(spark, calls, schemas.GENOTYPES), sites)
    [line] = data.collect()
    assert line["value"].split("\t")[9:] == [
        "0/0:1.0,0.0,0.0", "0/1:0.1,0.9,0.0", "0/0:0.9,0.1,0.0", "0/0:1.0,0.0,0.0", "0/1:0.0,1.0,0.0",
    ]


def test_files_of_different_samples(spark, monkeypatch):
    """Each file's calls get its own names, also where names are too many to be sent to all tasks."""
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"])

    def line(cpra, *calls):
        c, p, r, a = cpra.split(":")
        return "\t".join([c, p, cpra, r, a, ".", ".", ".", "GT", *calls])

    rows = [
        ("one", "##meta"), ("one", f"{head}\tA\tB\tC"), ("one", line("1:5:A:C", "0/1", "1/1", "./.")),
        ("two", f"{head}\tD\tA"), ("two", line("2:6:G:T", "0/0", "0/1")), ("two", line("2:7:G:T", "1/1", "0/0")),
        ("three", f"{head}\tA\tB\tC"), ("three", line("3:1:A:T", "1|0", "0/0", "0/0")), ("none", head), ("none", line("4:1:A:T")),
    ]
    lines = cohorts.table(spark, rows, "file string, value string")
    want = {
        ("A", "1:5:A:C", 1), ("B", "1:5:A:C", 2), ("C", "1:5:A:C", -1), ("D", "2:6:G:T", 0), ("A", "2:6:G:T", 1),
        ("D", "2:7:G:T", 2), ("A", "2:7:G:T", 0), ("A", "3:1:A:T", 1), ("B", "3:1:A:T", 0), ("C", "3:1:A:T", 0),
    }
    for most in (1000, 0):
        monkeypatch.setattr(vcf, "BROADCAST_NAMES", most)
        monkeypatch.setattr(vcf, "BROADCAST_FILES", most)
        got = vcf.parse_array(lines, None, allow_full_scan=True)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    headers = vcf.sample_headers(lines)[1]
    assert headers.select("header").distinct().count() == 2
    short = lines.unionByName(cohorts.table(spark, [("two", line("2:8:G:T", "0/0"))], "file string, value string"))
    with pytest.raises(Exception, match="differ in number"):
        vcf.parse_array(short, None, allow_full_scan=True).collect()


def test_calls_are_named_line_by_line(spark):
    """Names meet a line before it is opened: no join runs over the calls. A header without names lets no call pass."""
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"])
    fixed = "1\t5\t1:5:A:C\tA\tC\t.\t.\t.\tGT:GP"
    lines = cohorts.table(spark, [("one", f"{head}\tA\tB"), ("one", f"{fixed}\t0/1:0.1,0.8,0.1\t0/0")], "file string, value string")
    got = vcf.parse_imputed(lines, None, allow_full_scan=True)
    assert {tuple(r) for r in got.collect()} == {("A", "1:5:A:C", 1.0, 0.8), ("B", "1:5:A:C", None, None)}
    above_opening, opening, _ = got._jdf.queryExecution().executedPlan().toString().partition("Generate")
    assert opening and "Join" not in above_opening
    unnamed = cohorts.table(spark, [("none", head), ("none", f"{fixed}\t0/1:0.1,0.8,0.1")], "file string, value string")
    with pytest.raises(Exception, match="differ in number"):
        vcf.parse_imputed(unnamed, None, allow_full_scan=True).collect()


def test_junk_numbers_stop(spark):
    from cohortgate.functions import coerce

    frame = cohorts.table(spark, [("1.5",), (" 2 ",), ("NA",), ("",), (None,), ("NaN",), ("1e-3",)], "t string")
    assert [r[0] for r in frame.select(coerce.optional_number(F.col("t"))).collect()] == [1.5, 2.0, None, None, None, None, 0.001]
    with pytest.raises(Exception, match="not a number: abc"):
        cohorts.table(spark, [("abc",)], "t string").select(coerce.optional_number(F.col("t"))).collect()


def test_summary_and_combined_manifest(spark):
    lines = cohorts.table(spark, [
        ("s", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"),
        ("s", "1\t5\t1:5:A:C\tA\tC\t.\t.\tDR2=0.71;AF=0.0135;RAF=0.98;PROP_TYPED=0.0"),
        ("s", "1\t6\t1:6:A:C\tA\tC\t.\t.\tDR2=.;AF=."),
    ], "file string, value string")
    summary = vcf.parse_summary(lines, None, allow_full_scan=True)
    calls = cohorts.table(
        spark, [("P1", "1:5:A:C", 1.0), ("P2", "1:5:A:C", 0.0), ("P3", "1:5:A:C", -1.0), ("P1", "2:7:G:T", -1.0)],
        "participant_id string, cpra string, gt_code double",
    )
    rows = {r["cpra"]: r for r in vcf.manifest_text(
        vcf.combined_manifest(summary, vcf.array_manifest(calls))).collect()}
    assert (rows["1:5:A:C"]["on_array"], rows["1:5:A:C"]["array_maf"], rows["1:5:A:C"]["imputed_maf"]) == ("TRUE", "0.25", "0.0135")
    assert (rows["1:6:A:C"]["dosage_r2"], rows["1:6:A:C"]["on_array"]) == ("NA", "FALSE")
    assert (rows["2:7:G:T"]["on_imputed"], rows["2:7:G:T"]["array_maf"]) == ("FALSE", "NA")


def test_kinship_pairs_in_name_order(spark):
    rows = [(f"P{i:03d}", "TRUE" if i % 3 == 0 else "0") for i in range(20)]
    frame = cohorts.table(spark, rows, "participant_id string, kinship_flag string")
    got = sorted((r["id1"], r["id2"]) for r in vcf.kinship_pairs(frame).collect())
    names = [p for p, k in rows if k == "TRUE"]
    assert got == list(zip(names[0::2], names[1::2], strict=False))


def test_delimited_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "extra,cpra,chrom,pos,ref,alt,build,biallelic,on_array,on_imputed,array_maf,imputed_maf,dosage_r2,"
        "annotation,inaccurate_annotation,multiallelic_variant\n"
        "x,10:5:C:G,10,5,C,G,GRCh38,TRUE,TRUE,FALSE,NA,,0.7,a,FALSE,FALSE\n"
    )
    row = tables.read_manifest(spark, str(tmp_path / "m.csv")).collect()[0]
    assert row["chrom"] == "10" and row["array_maf"] == "NA" and "extra" not in row.asDict()
    (tmp_path / "bad.csv").write_text("cpra\nx\n")
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_manifest(spark, str(tmp_path / "bad.csv"))
    fields = ["study_id", "cpra", "chrom", "pos", "ref", "alt", "build", "carrier_definition", "requested_source", "purpose"]
    record = dict.fromkeys(fields, "v") | {"pos": "5"}
    (tmp_path / "r.json").write_text(json.dumps(record, indent=1))
    assert tables.read_single_request(spark, str(tmp_path / "r.json")).collect()[0]["pos"] == "5"
    (tmp_path / "r.csv").write_text(",".join(fields) + "\n" + ",".join(["v"] * 10) + "\n" + ",".join(["w"] * 10) + "\n")
    assert tables.read_requests(spark, str(tmp_path / "r.csv")).count() == 2
    with pytest.raises(ValueError, match="exactly one row"):
        tables.read_single_request(spark, str(tmp_path / "r.csv"))


def test_shaped_source_and_registry(spark, tmp_path):
    (tmp_path / "array_calls_vcf.tsv").write_text(
        "participant_id\tcpra\tgt\tgq\tcall_rate\nA\t1:5:C:G\t0/1\t40\t0.99\nB\t1:5:C:G\t./.\t40\t0.99\n"
    )
    (tmp_path / "imputed_calls_bgen.tsv").write_text(
        "participant_id\tcpra\tdosage\tgp_00\tgp_01\tgp_11\nA\t1:5:C:G\t1.0\t0.02\t0.95\t0.03\n"
    )
    rows = {(r["participant_id"], r["source"]): r for r in tables.read_genotype_source(
        spark, "shaped_tsv", str(tmp_path)).collect()}
    assert rows["A", "array"]["gt_code"] == 1 and rows["B", "array"]["gt_code"] == -1
    assert rows["A", "imputed"]["max_gp"] == 0.95


def test_genotype_store_prunes_by_contig(spark, tmp_path):
    run = cohorts.tiny(spark)
    tables.write_genotypes(run.inputs.genotypes, f"{tmp_path}/g")
    stored = tables.read_genotypes(spark, f"{tmp_path}/g")
    assert "chrom" in stored.columns and stored.count() == run.inputs.genotypes.count()
    plan = stored.filter("chrom = '10' and cpra = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "PushedFilters: [IsNotNull(cpra)" in plan


def test_json_ledgers_and_policy_record(spark, tmp_path):
    assert tables.read_checkpoints(spark, f"{tmp_path}/none.jsonl").count() == 0
    frame = spark.createDataFrame(
        [(0, "R", {"a": "1"})], "seq bigint, request_id string, input_sha256 map<string,string>"
    )
    for _ in range(2):
        tables.append_json_lines(frame, f"{tmp_path}/ledger")
    assert tables.read_ledger(spark, f"{tmp_path}/ledger").count() == 2
    record = {
        "schema": DEPLOYMENT.policy_schema, "policy_id": "p", "version": "1", "min_cell": 10, "round_to": 5,
        "adjudicator_sha256": None,
    }
    path = tmp_path / "policy.json"
    path.write_text(json.dumps(record))
    assert tables.read_release_policy(spark, str(path), DEPLOYMENT).min_cell == 10
    for wrong in ({"min_cell": True}, {"min_cell": 0}, {"version": " "}, {"schema": "other"}, {"extra": 1}):
        path.write_text(json.dumps({**record, **wrong}))
        with pytest.raises(ValueError, match="malformed"):
            tables.read_release_policy(spark, str(path), DEPLOYMENT)
