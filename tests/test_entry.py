import subprocess
import sys

from tests.conftest import ROOT


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["image_id", "comp", "band", "max_abs", "total", "n"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = sys.modules['ripplet.llm'] = None; import __spark_entry__ as e; from ripplet.plans import registry; assert set(e.queries()) == set(registry.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
