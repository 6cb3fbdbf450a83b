"""The terms by which criterion lines are classified, as data.

A term is a sequence of tokens: words in lower case, ``#`` for a number and ``~`` for a unit of time.
``+`` after a word adds its plural, ``!`` its verb forms, both by rule.  Written for this engine from what
each signal means; only the names of the signals are fixed.
"""

from __future__ import annotations

NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
TIME_WORDS = ("minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years")

#: What a rule could compare.
ANCHOR_TERMS = {
    "numeric-threshold": """< #; <= #; > #; >= #; = #; more than #; less than #; greater than #; fewer than #; higher than #; lower than #; over #; above #;
        below #; under #; exceeding #; exceeds #; at least #; at most #; or equal to #; minimum of #; maximum of #; between #; up to #; not exceed #;
        # or more; # or less; # or older; # or younger; # or greater; # or above; # or higher; # or lower; # to #""",
    "age": "age+; aged; ~ old; elderly; adult+; child; children; infant+; adolescent+; newborn+; toddler+",
    "sex": "male+; female+; man; men; woman; women; boy+; girl+; sex; gender",
    "unit": "# %; # percent; # per cent",
    "time-window": """within # ~; within the last # ~; within the past # ~; within the previous # ~; last # ~; past # ~; previous # ~; preceding # ~; # ~ prior; # ~ before;
        # ~ preceding; # ~ after; # ~ since; # ~ ago; # ~ of; for # ~; during the # ~; every # ~""",
    "diagnosis": "diagnosis; diagnoses; diagnosed; diagnostic; history of; evidence of; signs of; symptom+; presence of; positive for; confirmed; documented; known; established; proven; biopsy; histologically",
    "medication": """medication+; medicine+; drug+; dose+; dosage+; prescribed; prescription+; therapy; therapies; treatment with; treated with; taking; receiving; receipt of; infusion+; injection+;
        vaccine+; vaccination+; antibiotic+; anticoagulant+; insulin; corticosteroid+; steroid+; statin+; opioid+; chemotherapy; radiotherapy; inhibitor+; antagonist+; diuretic+""",
    "clinical-condition": """disease+; disorder+; syndrome+; infection+; failure; insufficiency; impairment+; injury+; allergy+; allergic; cancer+; tumor+; tumour+; malignancy+; malignant; neoplasm+;
        metastasis+; metastatic; leukemia; stroke+; hemorrhage+; haemorrhage+; bleeding; embolism; infarction; ischemia; angina; arrhythmia+; hypertension; hypotension; diabetes; diabetic; obesity;
        asthma; epilepsy; seizure+; dementia; depression; schizophrenia; pregnant; pregnancy+; lactating; breastfeeding; breast feeding; nursing; hiv; sepsis; ulcer+; fracture+; transplant+;
        dialysis; surgery+; congenital; illness+""",
    "named-measure": """creatinine; hemoglobin; haemoglobin; hematocrit; platelet+; bilirubin; albumin; glucose; cholesterol; triglyceride+; potassium; sodium; blood pressure; heart rate; body weight;
        body mass index; bmi; ejection fraction; lvef; performance status; karnofsky; ecog; nyha; score+; neutrophil+; lymphocyte+; alt; ast; inr; gfr; egfr; clearance; transaminase+; oxygen saturation""",
}
#: What no rule can compare.
BLOCKER_TERMS = {
    "investigator-judgement": "investigator+; investigator's; physician's; clinician+; opinion+; judgment+; judgement+; judged; discretion; deemed; considered by; determined by; assessed by; in the view; believes",
    "vague-qualifier": """adequate; adequately; inadequate; sufficient; insufficient; appropriate; inappropriate; suitable; unsuitable; acceptable; unacceptable; reasonable; satisfactory; significant;
        significantly; clinically relevant; severe; serious; stable; unstable; uncontrolled; well controlled; poorly controlled; medically fit""",
    "consent-or-logistics": """consent; assent; willing; unwilling; willingness; able to; unable to; ability to; inability to; comply; compliance; noncompliance; cooperate; follow up; attend; questionnaire+;
        travel; residence; prisoner+; caregiver+; guardian+; legal representative+""",
    "open-ended-list": "including but; not limited to; such as; for example; e g; etc; and so on; any other; or other; any condition; any disease; among others; or similar",
    "intent-or-plan": "planned; planning; plan+ to; intend!; intention; scheduled; anticipate!; expected; likely; unlikely; potential; potentially; candidate+ for; considering; foreseeable",
    "exception-clause": "unless; except; exception+; apart from; other than; provided that; with the exclusion",
    "prognosis": "life expectancy; prognosis; expected survival; survival of; terminally; hospice",
    "interference": "interfere!; confound!; compromise!; preclude!; jeopardize!; jeopardise!; hinder!; impede!; put the patient at risk",
}
#: Units as they are written; capitals count.
UNIT_TERMS = "mg / dL; mg / dl; g / dL; g / dl; g / L; mmol / L; umol / L; mEq / L; IU / L; U / L; mL / min; ml / min; ng / mL; ng / ml; pg / mL; pg / ml; mm Hg; mmHg; kg / m; mg / kg; cells / mm; ^ # / L; * # / L; bpm"
#: Endings of words that name conditions, after three letters at least.
CONDITION_ENDINGS = ("itis", "osis", "emia", "aemia", "pathy", "oma", "plegia", "penia", "uria", "algia")


def plural(word: str) -> str:
    if word.endswith("is"):
        return word[:-2] + "es"
    if word.endswith("y") and word[-2] not in "aeiou":
        return word[:-1] + "ies"
    return word + ("es" if word.endswith(("s", "x", "ch", "sh")) else "s")


def verb_forms(word: str) -> list[str]:
    stem = word.removesuffix("e")
    return [word, word + "s", stem + "ed", stem + "ing"]


def terms(text: str) -> list[str]:
    """The terms of an entry of the tables with all their forms."""
    out = []
    for term in text.split(";"):
        words = term.split()
        at = next((i for i, w in enumerate(words) if w[-1] in "+!" and len(w) > 1), None)
        if at is None:
            out.append(" ".join(words))
            continue
        base = words[at][:-1]
        for form in [base, plural(base)] if words[at][-1] == "+" else verb_forms(base):
            out.append(" ".join([*words[:at], form, *words[at + 1 :]]))
    return list(dict.fromkeys(out))


def term_rows(tables: dict[str, str]) -> list[tuple[str, str]]:
    """(signal, term) rows; an ending is the term ``-ending`` and a unit is a term with ``$`` before it."""
    out = [(signal, t) for signal, text in tables.items() for t in terms(text)]
    if "unit" in tables:
        out += [("unit", "$" + t) for t in terms(UNIT_TERMS)]
    if "clinical-condition" in tables:
        out += [("clinical-condition", "-" + e) for e in CONDITION_ENDINGS]
    return out


ANCHORS, BLOCKERS = term_rows(ANCHOR_TERMS), term_rows(BLOCKER_TERMS)
