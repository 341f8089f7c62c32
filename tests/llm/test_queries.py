import __spark_entry__ as entry
from melisma.llm import queries as llm


def test_every_written_query_is_registered():
    named = {n for n in vars(llm) if n[0] == "p" and n[1].isdigit()}
    assert named and named <= set(entry.queries())
