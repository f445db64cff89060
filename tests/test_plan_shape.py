"""Plan shape: texts move once to be lexed, tokens never after that; scans read what they need."""

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _above(plan, what, stop):
    """The nodes between every scan of ``what`` and the next ``stop`` above it."""
    lines = plan.split("\n")
    depth = [len(ln) - len(ln.lstrip(" :+-")) for ln in lines]
    for i, ln in enumerate(lines):
        if "FileScan" in ln and what in ln:
            d, found = depth[i], []
            for j in range(i - 1, -1, -1):
                if depth[j] < d:
                    d = depth[j]
                    found.append(lines[j].strip(" :+-"))
                    if stop in lines[j] or "Aggregate" in lines[j]:
                        break
            yield found


def test_tokens_stay_where_they_are(spark):
    """Tokens are read in the buckets they were written in: neither the span lookup nor the token join
    moves or broadcasts them; what moves is spans and chunk totals."""
    from spanlab.operators import align
    from spanlab.plans.lineage import Lineage
    L = Lineage(spark, SF_SMALL)
    lookup = align.locate(L.span_stream, L.token_table, extra_key=["src"], totals=L.totals, places=True)
    for plan in (_plan(lookup), _plan(L.aligned_plan)):
        assert "BroadcastExchange" not in plan and "NestedLoop" not in plan
        nodes = [n for n in _above(plan, "spanlab_tokens", "SortMergeJoin") if "SortMergeJoin" in n[-1]]
        assert nodes and not any("Exchange" in x for n in nodes for x in n), nodes


def test_texts_are_placed_once_to_be_lexed(spark):
    from spanlab.operators import lexer
    from spanlab.plans.lineage import english
    from spanlab.sources import corpus as C
    plan = _plan(lexer.token_chunks(english(C.corpus(spark, SF_SMALL))))
    assert plan.count("Exchange") == 1 and plan.count("REPARTITION_BY_NUM") == 1
    assert plan.count(lexer.LEX_RX) == 1        # one pass of the lexer


def test_scan_prunes_columns_and_pushes_language_filter(spark):
    from spanlab.plans.lineage import Lineage
    L = Lineage(spark, SF_SMALL)
    plan = L.docs_en._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    pushed = [ln.split("PushedFilters:")[1].split("ReadSchema")[0] for ln in plan.split("\n") if "PushedFilters" in ln]
    assert pushed and all("EqualTo(lang,en)" in x for x in pushed), pushed
    nested = L.annotated_en._jdf.queryExecution().executedPlan().toString()
    pushed = [ln for ln in nested.split("\n") if "PushedFilters" in ln]
    assert pushed and all("EqualTo(lang,en)" in ln for ln in pushed), pushed


def test_set_operations_scan_once(spark):
    """One scan per branch of the corpus (given rows, planted rows) in every set operation."""
    from spanlab.operators import prep
    from spanlab.plans.lineage import Lineage
    L = Lineage(spark, SF_SMALL)
    base = L.spans_all._jdf.queryExecution().executedPlan().toString().count("FileScan")
    for op in (prep.label_intersect, prep.label_except, prep.label_scope, prep.assert_label_set):
        assert op(L.spans_all)._jdf.queryExecution().executedPlan().toString().count("FileScan") == base, op
