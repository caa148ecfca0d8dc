"""Word lists and patterns that results depend on."""

from __future__ import annotations

# Patterns, searched without regard to case. Alternatives that can never match are part of the values.
PATTERNS = {
    "unclear": r"\[unclear\]",
    "praise": r"\b(well done|good job|great job|excellent|fantastic|brilliant|amazing|perfect|superb|wonderful|well said|nice work|good work|that'?s? (right|correct|good|great))\b",
    "tutor_placeholder": r"\[tutor_name\]",
    "feedback_incorrect": r"\b(not quite|that'?s? not (right|correct|quite right)|not (exactly|right|correct)|no[,.]?\s+that'?s?|almost but|close but not|not quite right|that'?s? (wrong|incorrect)|no[,.]?\s+(it'?s?|the answer|that) (is |was )?(not|wrong|incorrect))\b",
    "backchannel": r"^\s*(i see|okay|ok|right|mm.?hmm|uh.?huh|yes|yeah|indeed|alright|all right|sure|of course|absolutely|certainly|got it|cool|nice|great|yep)\s*[.,!?]?\s*$",
    "prompt_explanation": r"\b(how did you (get|do|work out|arrive at|figure)|why (did|do|is|are|does|would|have)\b|can you explain|walk (me )?through|explain (why|how|that|your (thinking|reasoning|answer|working))|what made you|tell me (why|how)|why is that\b|how do you know|what'?s? your (reasoning|thinking)|what were you thinking|show (your )?working|show (your )?work|your turn)\b|(why|how)\?\s*$",
    "prompt_next_step": r"\b(what (is|are|do|would|will|'?s) (the |you |we |your )?(next( step)?|do next)|what comes next|so what (do we|should we|would you|are we) (do|doing)\b|and then (what|where)\??|what (should|do) (we|you) do (now|next)\b|what'?s? (the )?next (step|thing))\b|(next|then)\?\s*$",
    "prompt_self_correction": r"\b(try (that )?again|have (another|a second|a closer) look|check (your|that) (work|answer|calculation|solution)\b|look at that again|are you sure( about that)?\??|double.?check|go back (and|to)\b|re.?check (that|it|your)\b|does that (look|seem) right\??|have (a look|a think) at|let'?s? (re.?check|look again))\b",
    "prompt_representation": r"\b(draw (a |the )?(picture|diagram|sketch|it out?|that)\b|show (me )?(another|a different) way|write (it )?(as|out|differently|another way)\b|represent (it|that)\b|sketch (it|that|a)\b|can you (draw|sketch|show me))\b",
    "hint": r"\b(remember (that|when|how|what|the|to)\b|think about\b|what do you (know|remember) about|here'?s? (a |one )?(clue|hint)|think back (to|about)\b|don'?t forget\b|have you (thought|considered) about|what (else )?do you know (about)?\b|clue[: ]|hint[: ])\b",
    "example": r"\b(for (example|instance)\b|think of it (like|as)\b|imagine (if|you|that|a |an )|let'?s? say\b|such as\b|as an example\b|picture (a |the |this |that )|like (a |an )\w)\b",
    "procedural": r"\b(first[,. ]+(you|we|let'?s?|thing)\b|step (one|two|three|four|five|1|2|3|4|5)( is)?[: ]|(the )?first (step|thing) (is |to )|next[, ]+(you|we)\b|after (that|this)[, ]+(you|we)\b|start (by|with) |begin (by|with) |then[, ]+(you|we|divide|multiply|add|subtract|simplify|expand|factorise?)\b|finally[, ]+(you|we)\b)\b",
    "conceptual": r"\b(the reason (is|why|we do|this works|that works)\b|that'?s? why\b|what (this|that) means (is )?\b|the (key |underlying |core |main )?(idea|concept|principle) (is|here|behind)\b|(this|that) works because\b|(we|you) (use|need|do this) because\b|mathematically[,. ]\b|the rule is (that|because|since)\b|this is (true|correct|right) because\b)\b",
    "prior_knowledge": r"\b(what do you (already )?(know|remember) (about|from)\b|have you (seen|done|learned|come across|studied|covered|heard of) (this|that|these)\b|do you remember (when|how|what|learning|doing)\b|what can you tell me about\b|what (have you|did you) (learn|do|cover) (about|in)\b|(have|did) you (ever )?(see|do|learn|hear about) (this|that|these)\b|remember (this|that)\b|seen this before\b|done this before\b)\b",
    "gives_answer": r"\b(the (answer|solution|result|value) is\b|it'?s? equals? \d|it'?s? equal to\b|the final (answer|result)\b|so (it'?s?|that'?s?|x|y|the answer) (is |=\s*|equals? )\d|which (gives|equals?) \d|that (gives|equals?) (us |you )?\d|equals? \d+\.?\d*)\b",
    "bare_answer": r"^\s*[a-z]?\s*=?\s*[-+]?\d+\.?\d*\s*[.!]?\s*$",
    "tag_question": r"(right\?|yes\?|okay\?|ok\?|isn'?t (it|that)\?|doesn'?t (it|that)\?|aren'?t (they|we)\?|don'?t (you|we)\?|can'?t (you|we)\?|do you (see|understand|follow|agree|get (it|that))\?|(make|makes) sense\?|got it\?|(does|do) that make sense\?)\s*$",
    "student_explains": r"\b(because\b|since\b|so that\b|that'?s? (why|because)\b|the reason (is|why)\b|which means\b|therefore\b|cos\b|cus\b|coz\b|which gives\b|which leaves\b|giving us\b|so (it|the|we|that|this)\b)\b",
    "confusion": r"\b(i don't get|don't understand|confus|stuck|i'm lost|i am lost|no idea|i don't know|idk|what do you mean|don't know how|not sure how|can you repeat)\b",
    "resolution": r"\b(i see|makes sense|got it|i get it|understand now|now i get|now i understand|oh i see|that makes sense|i understand)\b",
    "self_explanation": r"\b(because|therefore|since|that means|which means|thus|that's why|the reason|so that|cos|cus|coz|which gives|which leaves|giving us)\b",
    "hedge": r"\b(maybe|i think|i guess|not sure|probably|perhaps|might be|i'm not sure)\b",
    "elicit": r"\b(why|how|what do you think|can you explain|explain|what's next|walk me through|show me how|show your working|show your work|your turn|any thoughts|tell me why|tell me how|justify|prove|what makes)\b",
    "tell": r"\b(the answer is|answer is|you just|you simply|all you have|all you need|you have to|you need to|it's just|so it's just|just multiply|just add|just divide|first you|then you|step 1|step one)\b",
    "confirm": r"\b(exactly|correct|well done|good job|perfect|brilliant|that's right|that is right|spot on|good|great|nice|fantastic)\b",
    "corrective": r"\b(not quite|try again|not right|that's wrong|that is wrong|incorrect|not exactly|that's not|almost)\b",
    "maths": r"(\d|plus|minus|times|divid|multipl|equals?|subtract|\badd\b|sum|product|fraction|percent|decimal|remainder|squared?)",
    "deep_question": r"\b(why|how)\b",
    "shallow_question": r"\b(what('s| is) the answer|is it|what is it|is that right)\b|(right|correct)\s*\?\s*$",
    "states_answer": r"\b(the answer is|answer is|the result is|the solution is|it equals|it'?s? equal to|that equals|so it'?s?\s+\d|the value is|which gives us|that gives us)\b",
    "check_understanding": r"(makes? sense|got it\b|got that\b|with me\b|are you with|does that\b|are you following|you following|\bright\?|\bok\?|\bokay\?|\bclear\?|understand\?)",
    "verdict_positive": r"\b(exactly|that'?s? (right|correct|it)|that is (right|correct)|well done|good job|perfect|brilliant|spot on|fantastic|superb|lovely|you'?(ve)? got it|nailed it|bang on|absolutely right|correct\b|yes[,.!]? (that|it|you)('?s| is| are| do| did)?\b)",
    "verdict_negative": r"\b(not quite|not right|not correct|not exactly|that'?s? (wrong|incorrect)|that is (wrong|incorrect)|incorrect\b|try again|have another (look|go|try)|are you sure|double.?check|check (that|your|it) again|look at that again|close but|almost\b|nearly\b|not what|no[,.!]? (that|it|not|the answer|we|you)\b|nope\b|careful\b|watch out|hold on\b|hang on\b)",
    "first_session": r"first (?:session|lesson|time)|very first",
    "prior_session": r"last (?:week|time|session)|previous session|since our last|we did last|carried on from",
}
# The cue before a name is found in any case, the name only with a capital; these words are no names.
NAME_CALL = r"(?i:hello|hi|hey|okay|ok|alright|all\s+right|welcome|great|good|nice|yes|yep|yeah|come\s+on|so|now|right|remember|well\s+done|perfect|excellent|wonderful|brilliant|fantastic|well)[,!?.\s]+([A-Z][a-z]{1,14})(?:[,!?.\s]|$)"
NOT_NAMES = "okay what now job effort hello please explanation amazing thank see yes yeah no great good nice right well so come all".split()
# Words that carry no topic, for objectives.
OBJECTIVE_STOPS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might shall can not no nor so yet both either whether if as while when where which who whom that this these those i you he she it we they me him her us them my your his its our their what how"
).split()
# Words that carry no topic in talk, hesitations, and acknowledgements.
TALK_STOPS = "the a an and or of to in is are was were be been am being on for with as at by this that these those it its do does did so we you i he she they them his him her your our their what how when which who why not no if than then from up out about can will would could should i'm you're it's that's there here have has had get got me my we'll let's go going just like one two also into over under more most".split()
FILLERS = "um uh er erm hmm mm mmm oh ah yeah okay ok".split()
ACKNOWLEDGEMENTS = "yeah yep yes ok okay mhm mm mmhmm uhhuh right sure cool alright yup k fine true exactly".split()
# Kinds of operation an objective names.
OPERATIONS = {
    "add": r"\badd|sum|plus|total\b", "sub": r"\bsubtract|minus|difference|take away\b", "mul": r"\bmultipl|times|product|array\b", "div": r"\bdivid|quotient|share\b", "frac": r"\bfraction|numerator|denominator|equivalent\b", "dec": r"\bdecimal\b", "pct": r"\bpercent|percentage\b",
    "compare": r"\bcompar|order|greater|less|equal\b", "round": r"\bround|estimat|nearest\b", "place": r"\bplace value|digit|tens|hundreds|thousand\b", "measure": r"\bmeasur|length|mass|volume|capacity|time|money|cm|metre|gram\b", "geom": r"\bangle|shape|triangle|rectangle|polygon|perimeter|area|symmetr|coordinate\b",
    "negative": r"\bnegative\b", "ratio": r"\bratio|proportion|scale\b", "algebra": r"\bequation|expression|variable|formula|substitut\b", "word": r"\bproblem|context|word problem|real-life|real life\b", "multistep": r"\bmulti-step|multi step|two-step|then\b",
}
# Stems by topic strand and by level of thinking, the first that is found at the start of a word decides.
STRANDS = (
    ("Ratio", 4, ("ratio", "proportion", "proportional", "scale factor", "direct proportion", "inverse proportion", "sharing in ratio", "capture.recapture", "capture-recapture",)),
    ("Statistics", 3, ("probability", "probabilities", "mean", "median", "frequency", "scatter", "survey", "histogram", "pictogram", "venn", "bar chart", "pie chart", "chart", "cumulative frequency", "box plot", "averages", "average speed",)),
    ("Algebra", 1, ("equation", "expression", "formulae", "formula", "substitut", "factoris", "factoriz", "quadratic", "simultaneous", "inequalit", "completing the square", "like terms", "symbols and letters", "function notation", "function machine", "arithmetic sequence", "double bracket", "triple bracket", "single bracket", "unknown on both sides", "two unknowns", "change the subject", "rearranging formula", "nth term", "sequence", "y=mx", "y=x", "y=-x", "linear equation", "linear graph", "index law",)),
    ("Geometry", 2, ("pythagor", "trigonometr", "sohcahtoa", "vector", "angle", "triangle", "circle", "quadrilateral", "polygon", "perimeter", "volume", "surface area", "coordinat", "symmetr", "transform", "reflect", "rotat", "translat", "parallel", "perpendicular", "congruent", "similar shape", "bearing", "locus", "sector", "arc", "prism", "cylinder", "sphere", "cuboid", "net", "tessellat", "vertex", "vertices", "edge", "face", "2d shape", "3d shape", "area of", "area and", "calculating area", "solving area", "finding area", "area,", "shape",)),
    ("Number", 0, ("fraction", "decimal", "place value", "digit", "factor", "multiple", "prime", "count", "add", "subtract", "multipl", "divid", "percent", "money", "round", "negative", "integer", "times table", "table", "number", "measur", "mass", "weight", "capacity", "length", "speed", "calculat", "mental", "estimat", "approximat", "power", "square root", "cube root", "cube number", "standard form", "surd", "scale", "bar model", "hundred", "tens and ones", "tens to", "tens", "hcf", "lcm", "highest common factor", "lowest common multiple", "telling the time", "units of time", "time to", "quarter past", "quarter to", "half past", "difference", "remainder", "inverse", "operation", "known fact", "halving", "doubling", "making a whole", "recognis", "coin", "sharing", "grouping", "upper bound", "lower bound", "multi-step", "area model",)),
)
LEVELS = (
    (4, ("analys", "compar", "distinguish", "examin", "investigat", "differenti", "classify", "categoris", "interpret", "identify pattern",)),
    (3, ("calculat", "solv", "apply", "comput", "construct", "demonstrat", "convert", "determin", "estimat", "find", "measur", "produc", "record", "show", "work out", "work with", "expand", "simplif", "substitut", "factoris", "rearrang", "forming", "generating", "performing", "drawing", "writing", "telling",)),
    (2, ("explain", "describ", "recognis", "understand", "illustrat", "paraphras", "summar", "represent", "reason", "justif", "seeing", "developing fluency",)),
    (1, ("recall", "state", "name", "list", "defin", "memoris", "know", "label", "match", "select", "identif",)),
)


def stems(words: tuple[str, ...]) -> str:
    """One pattern for stems: each only at the start of a word, its signs taken literally."""
    quoted = ["".join(c if c.isalnum() or c in " ,=" else "\\" + c for c in w) for w in words]
    return r"\b(" + "|".join(quoted) + ")"
