"""Dialogue codes: role, axis, prior and pseudo-count of each."""

from __future__ import annotations

# Code, role, axis, prior rate, pseudo-count.
CODES = (
    ("ANSWER_ONLY", "student", "bare", 0.268468, 14.838),
    ("ASKING_QUESTION", "tutor", "ask", 0.303358, 14.621),
    ("CONFUSION_EXPRESSED", "student", "struggle", 0.037346, 51.87),
    ("EXPLAINING_CONCEPTUAL", "tutor", "tell", 0.036067, 25.134),
    ("EXPLAINING_PROCEDURAL", "tutor", "tell", 0.058784, 23.857),
    ("EXPLAINING_TOOL", "tutor", "manage", 0.009637, 32.758),
    ("FEEDBACK_CORRECT", "tutor", "fbpos", 0.088575, 21.494),
    ("FEEDBACK_INCORRECT", "tutor", "fbneg", 0.018471, 49.819),
    ("FEEDBACK_NEUTRAL", "tutor", "uptake", 0.028676, 28.583),
    ("FRUSTRATION", "student", "struggle", 0.003203, 12.337),
    ("GIVING_ANSWER", "tutor", "tell", 0.014881, 27.285),
    ("GIVING_EXAMPLE", "tutor", "scaffold", 0.006623, 55.568),
    ("GIVING_HINT", "tutor", "scaffold", 0.034988, 32.585),
    ("GIVING_PRAISE", "tutor", "fbpos", 0.076777, 23.369),
    ("GUIDING_SESSION", "tutor", "manage", 0.06555, 50.924),
    ("INSIGHT_DELIGHT", "student", "insight", 0.012104, 67.808),
    ("MOTIVATING_RELEVANCE", "tutor", "manage", 0.002032, 60.884),
    ("NORMALIZING_DIFFICULTY", "tutor", "scaffold", 0.010319, 58.953),
    ("OFFERING_CHOICE", "tutor", "ask", 0.005881, 91.732),
    ("PROMPTING_ALTERNATIVE_REPRESENTATION", "tutor", "elicit", 0.005898, 62.618),
    ("PROMPTING_NEXT_STEP", "tutor", "elicit", 0.020814, 32.08),
    ("PROMPTING_RELATED_CONCEPTS", "tutor", "elicit", 0.010894, 49.314),
    ("PROMPTING_SELF_CORRECTION", "tutor", "elicit", 0.015552, 63.444),
    ("PROMPTING_SELF_EXPLANATION", "tutor", "elicit", 0.078456, 32.473),
    ("REASONING_SHOWN", "student", "reason", 0.169928, 15.266),
    ("RELEASE_HANDOFF", "tutor", "elicit", 0.053235, 44.6),
    ("RESTATING", "tutor", "uptake", 0.011958, 36.878),
    ("REVOICING", "tutor", "uptake", 0.017075, 43.853),
    ("SEEKING_CLARIFICATION", "student", "seek", 0.06531, 41.465),
    ("SELF_CORRECTING", "student", "reason", 0.018238, 50.411),
    ("SIMPLIFYING_TO_SUBPROBLEM", "tutor", "scaffold", 0.001225, 13.34),
    ("STUDENT_NO_MOVE", "student", "sresid", 0.183111, 16.987),
    ("STUDENT_OTHER", "student", "sresid", 0.036314, 21.958),
    ("STUDENT_SOCIAL", "student", "sresid", 0.074467, 72.645),
    ("STUDENT_TECHNICAL", "student", "sresid", 0.04102, 10.922),
    ("STUDENT_UNINTELLIGIBLE", "student", "sresid", 0.089521, 16.786),
    ("SUMMARIZING_PROGRESS", "tutor", "uptake", 0.01146, 63.047),
    ("TRANSFER_PROBE", "tutor", "ask", 0.001369, 16.252),
    ("TUTOR_NO_MOVE", "tutor", "admin", 0.009028, 63.382),
    ("TUTOR_OTHER", "tutor", "manage", 0.019509, 23.823),
    ("TUTOR_SOCIAL", "tutor", "admin", 0.058053, 91.321),
    ("TUTOR_TECHNICAL", "tutor", "admin", 0.048656, 10.131),
    ("TUTOR_UNINTELLIGIBLE", "tutor", "admin", 0.018144, 9.074),
    ("WORKED_DEMONSTRATION", "tutor", "tell", 0.015801, 39.323),
)
# Pseudo-count of shrunken rates, last turns of windowed rates, the smallest mass, the cap of ratios.
KAPPA, WINDOWS, LEAST_MASS, RATIO_CAP = 25, (12, 24, 48), 0.001, 10.0
# Codes that say a turn taught nothing, and named subsets.
RESIDUAL = {"tutor": ("TUTOR_NO_MOVE", "TUTOR_SOCIAL", "TUTOR_TECHNICAL", "TUTOR_UNINTELLIGIBLE"), "student": ("STUDENT_NO_MOVE", "STUDENT_SOCIAL", "STUDENT_TECHNICAL", "STUDENT_UNINTELLIGIBLE")}
ASK = ("ASKING_QUESTION", "PROMPTING_ALTERNATIVE_REPRESENTATION", "PROMPTING_NEXT_STEP", "PROMPTING_RELATED_CONCEPTS", "PROMPTING_SELF_CORRECTION", "PROMPTING_SELF_EXPLANATION", "RELEASE_HANDOFF", "TRANSFER_PROBE", "OFFERING_CHOICE")
# Tutor and student codes of hard annotations.
MOVES = "PROMPTING_RELATED_CONCEPTS PROMPTING_ALTERNATIVE_REPRESENTATION PROMPTING_SELF_EXPLANATION PROMPTING_NEXT_STEP PROMPTING_SELF_CORRECTION FEEDBACK_CORRECT FEEDBACK_INCORRECT FEEDBACK_NEUTRAL REVOICING RESTATING GIVING_HINT GIVING_EXAMPLE EXPLAINING_CONCEPTUAL EXPLAINING_PROCEDURAL GIVING_ANSWER ADMINISTRATIVE".split()
STATES = "DEMONSTRATING_UNDERSTANDING CONFUSION_EXPRESSED SEEKING_CLARIFICATION SELF_CORRECTING OTHER ADMINISTRATIVE".split()
TELL = ("EXPLAINING_CONCEPTUAL", "EXPLAINING_PROCEDURAL", "GIVING_ANSWER", "WORKED_DEMONSTRATION")
ENGAGE, STRUGGLE = ("REASONING_SHOWN", "SELF_CORRECTING", "INSIGHT_DELIGHT"), ("CONFUSION_EXPRESSED", "FRUSTRATION", "SEEKING_CLARIFICATION")
