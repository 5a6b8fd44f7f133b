import logging

import pytest

from millrace import errors, session
from millrace.operators import governance


def test_retryable(spark):
    with pytest.raises(Exception) as missing:
        spark.sql("SELECT * FROM no_such_table")
    found = [errors.SourceUnavailable("x"), errors.SinkError("x"), errors.ModelError("x"), TimeoutError(), errors.SourceError("x"), errors.IndexMissing("x"), governance.Rejected("x"), missing.value, ValueError()]
    assert [errors.retryable(e) for e in found] == [True] * 4 + [False] * 5


def test_timed_and_warm(spark, caplog):
    with caplog.at_level(logging.INFO, "millrace"), session.timed("count", slow=1e9) as took:
        assert session.warm(spark.range(5)).is_cached
    assert took["seconds"] > 0 and "count took" in caplog.text
    with pytest.raises(ZeroDivisionError), caplog.at_level(logging.INFO, "millrace"), session.timed("bad", slow=0) as took:
        1 / 0
    assert caplog.records[-1].levelno == logging.WARNING
    spark.catalog.clearCache()
