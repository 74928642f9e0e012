"""The expression-based extractor against a plain Python reading of the same rules."""

import os
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cribra.operators import rules as R

PIECES = ["Inclusion Criteria:", "EXCLUSION:", "exclusion criteria :", "inclusion:",
          "Key Exclusion Criteria:", "main inclusion:", "Key", "key\n",
          "- Age 18 years or older", "* Pregnant or breastfeeding", "1. ECOG 0-1",
          "Creatinine 1.5 mg/dL", "active hepatitis B", "  ", "", "\t", "prior chemotherapy",
          "Measurable disease per RECIST", "Signed informed consent", "thyroid nodule."]


def python_extract(text: str):
    """Cut at headings, then lines; keep non-blank lines; bullets and trailing
    blanks removed; kind by the first matching rule."""
    head = re.compile(R.HEADING_RE)
    sections = head.split(text)
    # re.split also returns the captured groups: keep only the text chunks
    groups = head.groups
    chunks = sections[:: groups + 1]
    heads = [m.group(1) for m in head.finditer(text)]
    out = []
    for k, chunk in enumerate(chunks):
        excl = k > 0 and heads[k - 1].lower() == "exclusion"
        if k < len(chunks) - 1:
            chunk = re.sub(R.QUALIFIER_RE.replace("\\z", "\\Z"), "", chunk, count=1)
        for line in chunk.split("\n"):
            if not re.search(r"\S", line):
                continue
            t = re.sub(R.TRAIL_RE, "", re.sub(R.BULLET_RE, "", line, count=1), count=1)
            padded = " " + t.lower() + " "
            kind = next((k2 for k2, p in R.KIND_RULES if re.search(f"[^a-z]({p})", padded)),
                        R.FALLBACK_KIND)
            out.append((t, kind, excl))
    return [(i, ("exc-" if e else "inc-") + str(i), t, kind, e) for i, (t, kind, e) in enumerate(out)]


texts = st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from(["\n", " ", "\n\n", "  "])),
                 max_size=12).map(lambda parts: "".join(a + b for a, b in parts))


@settings(max_examples=int(os.environ.get("CRIBRA_EXAMPLES", "10")), deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=st.lists(texts, min_size=1, max_size=6))
def test_extractor_matches_python_reading(spark, docs):
    df = spark.createDataFrame([(f"NCT{i:08d}", t) for i, t in enumerate(docs)],
                               "nct_id string, eligibility string")
    got = {}
    for r in R.rule_criteria(df).collect():
        got.setdefault(r.nct_id, []).append((r.ordinal, r.criterion_id, r.text, r.kind, r.is_exclusion))
    for i, t in enumerate(docs):
        assert sorted(got.get(f"NCT{i:08d}", [])) == python_extract(t), t
