"""The parsing chain is written with generated methods that the JVM compiles."""

from tidewright import session
from tidewright.operators import load
from tidewright.plans import fixtures


def test_parsed_rows_are_written_under_the_limit_and_it_is_put_back(spark, monkeypatch):
    seen, before = [], spark.conf.get(session.METHOD_LIMIT)
    plain = session.shared_folder

    def looked(s):
        seen.append(int(s.conf.get(session.METHOD_LIMIT)))
        return plain(s)

    monkeypatch.setattr(session, "shared_folder", looked)
    sf = "/root/testdata/sf0.001"
    load.annotate(fixtures.raw(spark, sf, "invoices"), fixtures.INVOICE_SPEC, fixtures.canonical_customers(spark, sf))
    assert seen[0] <= 8000 and spark.conf.get(session.METHOD_LIMIT) == before
