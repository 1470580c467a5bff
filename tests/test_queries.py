"""Every registered query of the engine beside its SQL, and entry points without the optional part."""

import subprocess
import sys

import oracle
import pytest

from facetline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, SF, registry.queries()[name], registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_works_without_the_optional_part():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("facetline.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.llm is None and "knn_top2" in e.queries() and not any(n.startswith("op") for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_commits_are_listed_whole(spark):
    out = registry.queries()["commit_list"](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/orders.parquet").count() > 100


def test_list_commits_has_no_limit_by_default(spark, monkeypatch):
    from facetline.plans import api

    class Few:
        def table(self, name):
            return spark.range(50).withColumnRenamed("id", "created_at")

    monkeypatch.setattr(api.aggregates, "commit_summary", lambda commits, ledger: commits.withColumn("id", commits.created_at))
    assert [api.list_commits(Few(), *n).count() for n in ((), (0,), (7,))] == [50, 50, 7]
