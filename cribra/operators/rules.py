"""Built-in extractor: eligibility prose to typed criteria by section and keyword rules.

It stands in for a hosted model, so its quality is not comparable to one; what
it shares with one is the output contract (criterion_id, text, kind,
is_exclusion) and the twenty kinds.

The whole extraction is expressions over one row: the prose is cut at the
section headings, each section into lines, the non-blank lines become
criteria in document order. No shuffle, no Python, and a document's
criteria never leave its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.functions.text import has_text

# Ours: the section heading pattern ("Inclusion Criteria:", "EXCLUSION:"),
# the qualifier a heading may carry ("Key Exclusion Criteria:"),
# a leading bullet, and the whitespace trimmed around a criterion.
HEADING_RE = r"(?i)(inclusion|exclusion)( criteria)?[ \t]*:"
HEADING_STEM = "clusion"
QUALIFIER_RE = r"(?i)(key|main|major|additional|general)[ \t]*\z"
BULLET_RE = r"^[ \t\r\f]*(([-*•]|[0-9]{1,2}[.)])[ \t\r\f]+)?"
TRAIL_RE = r"[ \t\r\f]+$"
_TRAIL = " \t\r\f"    # the characters of TRAIL_RE, for a trim without a pattern

# Ours: kind rules in priority order, first match wins, ``other`` last.
# Each alternative must start a word (the text is lower-cased and padded with a
# space); a trailing ``[^a-z]`` closes a whole word.
KIND_RULES = (
    ("reproductive", "pregnan|lactat|breast[- ]?feed|contracep|childbearing|fertil|sterili"),
    ("consent", "consent|assent"),
    ("compliance", "complian|adhere|comply|follow[- ]up visit|willing to attend|reachable"),
    ("washout", "washout|[0-9]+ (days|weeks|months) (since|prior|before|after|from)"),
    ("procedure", "surgery|surgical|biops|transplant|radiotherap|radiation therap|resect"),
    ("concurrent_therapy", "concurrent|concomitant|another (clinical )?(trial|study)|investigational (agent|drug|product)"),
    ("prior_therapy", "prior (therapy|treatment|chemo|line|systemic)|previously treated|refractory|progressed (on|after)"),
    ("organ_function", "(renal|hepatic|liver|kidney|cardiac|bone marrow|marrow|organ) function"),
    ("lab", "creatinine|bilirubin|hemoglobin|haemoglobin|platelet|neutrophil|albumin|[0-9]+ ?(mg/dl|g/dl|mmol/l|x ?10\\^?9|/mm3|/ul)|uln[^a-z]"),
    ("infection", "hiv[^a-z]|hepatitis|hbv[^a-z]|hcv[^a-z]|tubercul|infection"),
    ("measurable_disease", "measurable|recist|evaluable (disease|lesion)"),
    ("life_expectancy", "life expectancy|expected survival"),
    ("allergy", "allerg|hypersensitiv|intoleran"),
    ("ecog", "ecog|karnofsky|performance status"),
    ("age", "age[^a-z]|aged [0-9]|years old|[0-9]+ years of age"),
    ("stage", "stage[^a-z]|metasta|unresectable|locally advanced|tnm[^a-z]"),
    ("biomarker", "egfr|alk[^a-z]|her2|kras|braf|pd-?l1|mutation|biomarker|overexpress"),
    ("comorbidity", "diabetes|hypertension|heart failure|myocardial|cardiovascular|autoimmune|psychiatric|seizure|comorbid"),
    ("condition", "cancer|carcinoma|tumou?r|lymphoma|leuka?emia|melanoma|sarcoma|neoplas|diagnos"),
)
FALLBACK_KIND = "other"


FAN = 5    # letters that one group of the trie compares in turn


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, cut at the bars outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c in "([") - (c in ")]")
        if c == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
    return [*out, pattern[start:]]


def _spelled(option: str) -> list[str]:
    """An option that begins with a choice, "(a|b) c", as one option for each: "a c", "b c"."""
    end = option.find(")")
    if not option.startswith("(") or "(" in option[1:end] or option[end + 1:end + 2] in ("?", "*", "+", "{"):
        return [option]
    return [a + option[end + 1:] for a in alternatives(option[1:end])]


def stem_trie(options: list[str]) -> str:
    """One pattern that is found where any of ``options`` is, with common beginnings written once.

    A word is compared with one branch for each first letter instead of with every
    option. A letter before a quantifier, and anything but a letter, stays as it is; an
    option that ends inside another makes the longer one needless.
    """
    branches: dict[str, list[str]] = {}
    other: list[str] = []
    for o in (x for o in options for x in _spelled(o)):
        if o[:1].isalpha() and o[1:2] not in ("?", "*", "+", "{"):
            branches.setdefault(o[0], []).append(o[1:])
        elif o not in other:
            other.append(o)
    tails = {letter: letter + ("" if "" in rest else stem_trie(rest)) for letter, rest in branches.items()}
    if len(tails) <= FAN:
        other += tails.values()
    else:
        # One look ahead spares a word the branches of all other letters.
        order = sorted(tails)
        for k in range(0, len(order), FAN):
            few = order[k:k + FAN]
            other.append(f"(?=[{''.join(few)}])(?:{'|'.join(tails[c] for c in few)})")
    return other[0] if len(other) == 1 and len(alternatives(other[0])) == 1 else "(?:" + "|".join(other) + ")"


def _word_start(pattern: str) -> str:
    return "[^a-z]" + stem_trie(alternatives(pattern))


# One look at each word decides whether any kind rule can match, so most lines skip the rules.
ANY_RULE_RE = _word_start("|".join(p for _, p in KIND_RULES))


def kind_of(text: Column) -> Column:
    """Ordered CASE over the keyword rules.

    One combined pattern is tried first, so a line that matches no rule (the
    common case) costs one regex scan instead of one per rule.
    """
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    expr = F.lit(FALLBACK_KIND)
    for kind, pattern in reversed(KIND_RULES):
        expr = F.when(padded.rlike(_word_start(pattern)), F.lit(kind)).otherwise(expr)
    return F.when(~padded.rlike(ANY_RULE_RE), F.lit(FALLBACK_KIND)).otherwise(expr)


def clean_line(line: Column) -> Column:
    return F.rtrim(F.regexp_replace(line, BULLET_RE, ""), F.lit(_TRAIL))


def criteria_items(text: Column, clean: bool = True) -> Column:
    """array<struct<is_exclusion, text>> in document order.

    Section k (k > 0) follows heading k-1; text before the first heading is
    inclusion. Headings may sit inside a line. With ``clean=False`` the lines
    are returned as found (callers that explode first clean them in codegen).
    """
    # The headings' common letters are sought first: most prose has none, and no
    # pattern needs to run over it.
    headed = F.contains(F.lower(text), F.lit(HEADING_STEM))
    sections = F.when(headed, F.split(text, HEADING_RE, -1)).otherwise(F.array(text))
    heads = F.when(headed, F.regexp_extract_all(text, F.lit(HEADING_RE), 1))

    def per_section(chunk: Column, k: Column) -> Column:
        exclusion = F.when(
            k > 0, F.lower(F.try_element_at(heads, k.cast("int"))) == "exclusion"
        ).otherwise(F.lit(False))
        # A chunk followed by a heading may end with the heading's qualifier
        # ("Key"); only those chunks are searched for it.
        body = F.when(k < F.size(sections) - 1, F.regexp_replace(chunk, QUALIFIER_RE, "")) \
                .otherwise(chunk)
        lines = F.filter(F.split(body, "\n", -1), lambda line: has_text(line))
        return F.transform(lines, lambda line: F.struct(
            exclusion.alias("is_exclusion"),
            (clean_line(line) if clean else line).alias("text")))

    return F.flatten(F.transform(sections, per_section))


def extract_criteria(text: Column) -> Column:
    """The extractor's result column: array<criterion> (empty for blank prose)."""
    items = criteria_items(text)
    return F.when(~has_text(text), F.array().cast(
        "array<struct<criterion_id:string,text:string,kind:string,is_exclusion:boolean>>"
    )).otherwise(F.transform(items, lambda it, i: F.struct(
        F.concat(F.when(it["is_exclusion"], F.lit("exc-")).otherwise(F.lit("inc-")),
                 i.cast("string")).alias("criterion_id"),
        it["text"].alias("text"),
        kind_of(it["text"]).alias("kind"),
        it["is_exclusion"].alias("is_exclusion"),
    )))


def rule_criteria(docs: DataFrame, id_col: str = "nct_id", text_col: str = "eligibility",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per criterion: (id, ordinal, criterion_id, text, kind, is_exclusion).

    Same result as exploding ``extract_criteria``, but only the cutting into
    lines runs inside array lambdas; cleaning and the kind rules run after the
    explode, inside whole-stage codegen with shared subexpressions.
    """
    exploded = docs.select(
        F.col(id_col).alias(id_col), *keep,
        F.posexplode(criteria_items(F.col(text_col), clean=False)).alias("ordinal", "c"),
    )
    text = clean_line(F.col("c.text"))
    return exploded.select(
        id_col,
        F.col("ordinal").cast("int").alias("ordinal"),
        F.concat(F.when(F.col("c.is_exclusion"), F.lit("exc-")).otherwise(F.lit("inc-")),
                 F.col("ordinal").cast("string")).alias("criterion_id"),
        text.alias("text"),
        kind_of(text).alias("kind"),
        F.col("c.is_exclusion").alias("is_exclusion"),
        *keep,
    )


# Extractor identity: what the signature must cover so that any change to the
# rules re-queues the affected trials.
EXTRACTOR_MATERIAL = {
    "extractor": "cribra.rules",
    "version": 1,
    "heading": HEADING_RE,
    "qualifier": QUALIFIER_RE,
    "bullet": BULLET_RE,
    "trailing": TRAIL_RE,
    "rules": [list(r) for r in KIND_RULES],
    "fallback": FALLBACK_KIND,
    "schema": "criterion_id:string,text:string,kind:string,is_exclusion:boolean",
}
