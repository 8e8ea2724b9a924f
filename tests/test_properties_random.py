"""Randomized round trips: rendered shell assignments parse back to their
values (S1), and key/value tables survive the properties writer and reader
(K2 then S3)."""

import os
import tempfile

from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st

from fleetframe.sinks.writers import write_properties
from fleetframe.sources.conf import parse_conf
from fleetframe.sources.properties import read_properties

KEY = st.from_regex(r"[A-Za-z_][A-Za-z0-9_]{0,12}", fullmatch=True)
TEXT = st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x202F,
                                      blacklist_characters="\x7f"), max_size=30)
BARE = st.from_regex(r"[A-Za-z0-9_./:,@%+-]{0,20}", fullmatch=True)


def _double_quoted(v: str) -> str:
    return '"' + "".join("\\" + ch if ch in '"$`\\' else ch for ch in v) + '"'


@st.composite
def assignments(draw):
    out = []
    for i in range(draw(st.integers(1, 25))):
        key = draw(KEY)
        style = draw(st.sampled_from(["dq", "sq", "bare"]))
        if style == "dq":
            v = draw(TEXT)
            rendered = _double_quoted(v)
        elif style == "sq":
            v = draw(TEXT.filter(lambda x: "'" not in x))
            rendered = "'" + v + "'"
        else:
            v = draw(BARE)
            rendered = v
        tail = draw(st.sampled_from(["", "  # note", "   "]))
        lead = draw(st.sampled_from(["", "  ", "export "]))
        out.append((i, key, v, f"{lead}{key}={rendered}{tail}"))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=assignments())
@example(rows=[(0, "A", "\x85\u2028x", 'A="\x85\u2028x"')])
def test_shell_values_round_trip(spark, rows):
    df = spark.createDataFrame([(i, line) for i, _, _, line in rows], "i int, line string")
    got = {r["i"]: (r["key"], r["value"]) for r in parse_conf(df).collect()}
    assert got == {i: (k, v) for i, k, v, _ in rows}


PKEY = st.from_regex(r"[a-z][a-z0-9_.]{0,15}", fullmatch=True)
PVAL = st.text(alphabet=st.characters(min_codepoint=33, max_codepoint=0x17F), max_size=25)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(kv=st.dictionaries(PKEY, PVAL, min_size=1, max_size=30))
def test_properties_round_trip(spark, kv):
    out = os.path.join(tempfile.mkdtemp(prefix="ff-props-"), "p")
    write_properties(spark.createDataFrame(sorted(kv.items()), "key string, value string").coalesce(1), out)
    back = {r["key"]: r["value"] for r in read_properties(spark, out + "/*.txt").collect()}
    assert back == kv
