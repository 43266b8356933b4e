import pytest
from conftest import TINY
from tidemark.operators import investigate
from tidemark.operators.retrieval import REFUSAL, parse_id
from tidemark.sources import fixtures as fx


@pytest.fixture(scope="module")
def world(spark):
    return fx.event_transactions(spark, TINY).cache(), fx.dim_customer(spark, TINY), fx.dim_merchant(spark, TINY), fx.dim_device(spark, TINY)


def never(_):
    raise AssertionError("the model must not be asked")


@pytest.mark.parametrize("bad", [-1, None, "", "x"])
def test_refusal_without_the_model(world, bad):
    out = investigate.investigate(bad, *world, generate=never)
    assert not out["found"] and out["answer"] == REFUSAL and out["evidence"] == {}


def test_known_id_is_answered_and_audited(spark, world, tmp_path):
    path = f"file://{tmp_path}/audit"
    out = investigate.investigate(3, *world, audit_path=path, k=2)
    investigate.investigate("nope", *world, audit_path=path, generate=never)
    assert out["found"] and "Recommended analyst action" in out["answer"] and len(out["evidence"]["policy_chunks"]) == 2
    audit = spark.read.parquet(path)
    assert audit.count() == 2 and dict(audit.dtypes)["transaction_id"] == "string"


def test_failing_audit_does_not_stop(world):
    assert investigate.investigate(3, *world, audit_path="nosuchscheme://x")["found"]


def test_parse_id():
    assert [parse_id(x) for x in (7, "7", None, "", "a")] == [7, 7, None, None, None]
