import os

import duckdb
import pytest

from twinmark.functions import vocab
from twinmark.plans import oracle, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    """Rows as sorted tuples over sorted column names, floats to 9 places."""
    order = sorted(range(len(columns)), key=lambda k: columns[k].lower())
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(fix(r[k]) for k in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(c.lower() for c in df.columns) == sorted(c.lower() for c in columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_the_mixed_lots_reach_every_branch(duck):
    """What the green rows of the four decision queries exercise: every guard, finding, status, level, action and text."""
    found = lambda name: duck.execute(registry.oracle_sql()[name]).df()
    classic, crossed = found("classic_decisions"), found("classic_decisions_cross_site")
    hard = {f"{f}_MISMATCH" for f, *_ in vocab.HARD_FIELDS}
    variants = {f"{g}_MISMATCH" for g in vocab.VARIANT_LABELS}
    assert set(classic.rejection_reason) == {"", "SAME_PART_NO", "CONTRACT_MISMATCH_IN_SAME_SITE_MODE", "GENERIC_DESCRIPTION", "APPLICATION_CONTEXT_MISMATCH"} | hard | variants
    assert "CONTRACT_MISMATCH" in set(crossed.rejection_reason) and vocab.CROSS_SITE in set(crossed.business_status)
    assert set(classic.business_status) == set(vocab.STATUSES) - {vocab.CROSS_SITE} and set(classic[classic.rejection_reason == ""].business_status) == {vocab.DUPLICATE, vocab.POSSIBLE, vocab.UNIQUE}
    assert set(classic.confidence_level) == {"HIGH", "MEDIUM", "LOW", "IGNORE"} and classic.generic_warning.any() and classic.context_warning.any()
    opened = ("Descriptions and part numbers match", "Descriptions are highly similar", "Descriptions show meaningful", "Both are ")
    assert all(classic.explanation.str.startswith(text).any() for text in opened)
    evidence, wide = found("evidence_decisions"), found("evidence_decisions_cross_site")
    assert set(evidence.rule_decision) == {o[2] for o in oracle.OUTCOMES} - {"CROSS_SITE_REVIEW"} and "CROSS_SITE_REVIEW" in set(wide.rule_decision) and "SCOPE_REJECT" in set(wide.rule_decision)
    assert set(evidence.business_status) | set(wide.business_status) == set(vocab.STATUSES)
    generic = evidence[evidence.rule_decision == "GENERIC_REVIEW"]
    assert set(generic.business_status) == {vocab.POSSIBLE, vocab.INSUFFICIENT}
    kinds = set("|".join(pd for frame in (evidence, wide) for pd in frame.difference_kinds).split("|"))
    assert {k for site in (False, True) for _, k, _ in oracle.evidence_findings(site)} <= kinds and "field:PRIME_COMMODITY" in kinds
    assert set(evidence.recommended_action) | set(wide.recommended_action) == set(vocab.STATUS_ACTIONS.values()) | {"Manual review recommended", "Not likely duplicate"}
    for text in ("but rating differs", "but color differs", "but function/media differs", "but type code differs", "HSN/SAC values differ", "Safety code values differ", "Matching evidence includes", "Matching evidence is limited"):
        assert evidence.explanation.str.contains(text, regex=False).any() or wide.explanation.str.contains(text, regex=False).any(), text


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_part_scores_are_made_for_rows_of_many_names(spark):
    """No row a pair goes to Python."""
    plan = registry.part_no_similarity(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan and plan.index("Generate") < plan.index("ArrowEvalPython")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["export_rows", "classic_results", "evidence_results"])
def test_results_are_made_for_pairs_of_classes(spark, name):
    """Rows of pairs come from generators over finished rows: nothing but part numbers is joined or scored for a pair."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan or "Generate posexplode" in plan
    assert "regexp" not in plan
