"""Queries that SQL does not check, against plain versions over the results they are made of."""

import glob
import hashlib
import os

import pytest

from attestry import registry
from attestry.functions import rules as R
from attestry.registry import Inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: registry.queries()[name](spark, SF).collect()


def test_manifest_of_files(run):
    want = sorted((os.path.basename(f), os.path.getsize(f), hashlib.sha256(open(f, "rb").read()).hexdigest()) for f in glob.glob(f"{SF}/*.parquet"))
    assert sorted((r["name"], r["size"], r["digest"]) for r in run("s3_file_manifest")) == want


def test_topic_versions(run):
    """Only documents that are new, or whose digest is another than the last known, get a revision."""
    want = set()
    for r in run("a18_topic_documents"):
        digest = hashlib.sha256(r.text.encode()).hexdigest()
        if r.owner == "owner-1":
            want.add((r.owner, r.scope, r.slug, digest, 1))
        elif r.slug == "alpha":
            want.add((r.owner, r.scope, r.slug, digest, 2))
    assert {(r.owner, r.scope, r.slug, r.digest, r.revision) for r in run("q6_topic_versions")} == want


def test_input_coverage(spark, run):
    """How much of each message some cited span covers, counted sign by sign."""
    covered = {}
    for r in run("f12_evidence_spans"):
        covered.setdefault((r.source_id, r.message_id), set()).update(range(r.start_char, r.end_char))
    sizes = {(r.source_id, r.message_id): (len(r.text), r.route) for r in R.routed(Inputs(spark, SF).v_pasted).collect()}
    got = {(r.source_id, r.message_id): (r["size"], r.route, r.covered, r.excluded, r.no_evidence) for r in run("q11_input_coverage")}
    assert got == {k: (n, route, len(covered.get(k, ())), n - len(covered.get(k, ())), not covered.get(k)) for k, (n, route) in sizes.items()}


def test_quality_summary(run):
    """Counts of what becomes of claims by source, over the claims' own rows."""
    want = {}
    for h in run("f20_review_hints"):
        n = want.setdefault(h.source_id, [0, 0, 0])
        n[0] += 1
        n[1] += h.disposition == "review_required"
        n[2] += h.disposition == "archive_only"
    assert want
    assert {r.source_id: [r.total, r.review_required, r.archive_only] for r in run("a20_quality_summary")} == want


def test_bulk_plan_covers_the_export(spark, run):
    """Every visible text lies in one segment, in order; one segment of each sampled conversation is its first."""
    texts = {}
    for r in Inputs(spark, SF).conversations.collect():
        texts.setdefault(str(r.conv_id), []).append((r.turn, r.text))
    rows = run("q7_bulk_plan")
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    for conv, segments in by.items():
        assert sorted(s.segment_index for s in segments) == list(range(len(segments)))
        assert sum(s.chars for s in segments) == sum(len(t or "") for _, t in texts[conv])
    assert {s.segment_index for s in rows if s.phase == "sample"} == {0}


def test_evidence_within_budget(run):
    """Chunks of a query in order of score, as many as the budget holds from the first on; bundles stay within theirs."""
    by = {}
    for r in run("q3_source_evidence"):
        by.setdefault(r.query_id, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert all(a.score >= b.score for a, b in zip(rows, rows[1:], strict=False))
        assert sum(r.end_char - r.start_char + 80 for r in rows[:-1]) <= 2000
    found = {(r.query_id, r["rank"]): r.end_char - r.start_char + 80 for rows in by.values() for r in rows}
    for r in run("q4_task_bundle"):
        assert r.group in ("trusted", "candidate", "original")
        assert r.group != "original" or (r.query_id, r["rank"]) in found
