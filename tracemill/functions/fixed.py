"""Patterns, word lists and constants that results depend on."""

# fmt: off
# Step patterns by family. All but the computation family are searched in the lower-cased paragraph.
VERIFICATION = [
    r"let me (check|verify|double.?check|confirm|validate|make sure)",
    r"(checking|verifying|double.?checking|confirming)",
    r"let's (check|verify|double.?check|confirm|make sure)",
    r"to (check|verify|confirm|validate) (this|that|our|the)",
    r"we can (check|verify|confirm)",
    r"substitut(e|ing) back",
    r"plug(ging)? (it |this )?back",
    r"sanity check",
    r"indeed[,.]",
    r"this (is correct|checks out|confirms|agrees|matches|is consistent)",
    r"which (confirms|verifies|checks out|matches|agrees)",
    r"as expected",
    r"consistent with",
]
COMPUTATION = [
    r"\d+\s*[+\-*/×÷^]\s*\d+\s*=\s*\d+",
    r"\\frac\{.*?\}\{.*?\}",
    r"\\sqrt\{.*?\}",
    r"= \d+",
    r"\\cdot",
    r"\\times",
    r"\\binom\{",
    r"\\sum",
    r"\\prod",
]
EXPLORATION = [
    r"let me (try|consider|think about|explore|approach)",
    r"another (way|approach|method|strategy)",
    r"what if",
    r"alternatively",
    r"on the other hand",
    r"perhaps",
    r"maybe (we|i) (should|could|can)",
    r"i wonder",
    r"one approach",
    r"suppose",
]
CORRECTION = [
    r"\bwait\b",
    r"\bactually\b[,.]",
    r"\bhold on\b",
    r"let me re(think|consider|do|calculate|start|examine)",
    r"that's (not right|wrong|incorrect)",
    r"i made (a |an )?(mistake|error)",
    r"\bcorrection\b",
    r"going back",
    r"this (is wrong|doesn't work|can't be right)",
    r"no[,.]? (that|this|wait)",
]
# The named patterns whose matches are counted (letter case ignored).
COUNTED = {
    "explicit_verify": r"let me (check|verify|double.?check|confirm|validate)",
    "active_verify": r"(checking|verifying|double.?checking)",
    "substitution_check": r"substitut(e|ing) back",
    "plug_back": r"plug(ging)? (it )?back",
    "confirmation": r"this (is correct|checks out|seems right|makes sense)",
    "sanity_check": r"sanity check",
    "wait": r"\bwait\b",
    "actually": r"\bactually\b",
    "negation": r"\bno,?\s",
    "hold_on": r"\bhold on\b",
    "rethink": r"let me re(think|consider|do|calculate)",
    "error_recognition": r"that's (not right|wrong|incorrect)",
    "mistake_admission": r"i made (a |an )?(mistake|error)",
    "explicit_correction": r"\bcorrection\b",
    "going_back": r"going back",
    "try_alternative": r"let me (try|consider|think about|explore)",
    "alternative_approach": r"another (way|approach|method)",
    "what_if": r"what if",
    "alternatively": r"alternatively",
    "other_hand": r"on the other hand",
    "examine": r"let's (see|look at|examine)",
    "perhaps": r"perhaps",
    "maybe": r"maybe",
    "wonder": r"i wonder",
}
COUNTED_VERIFICATION = ["explicit_verify", "active_verify", "substitution_check", "plug_back", "confirmation", "sanity_check"]
COUNTED_CORRECTION = ["wait", "actually", "negation", "hold_on", "rethink", "error_recognition", "mistake_admission", "explicit_correction", "going_back"]
COUNTED_EXPLORATION = ["try_alternative", "alternative_approach", "what_if", "alternatively", "other_hand", "examine", "perhaps", "maybe", "wonder"]

STEP_TYPES = ["verification", "computation", "exploration", "correction", "conclusion", "derivation"]
CHAIN_TYPES = ["derivation", "computation", "conclusion"]
LOOKBACK = 10

# Mathematical symbols of a paragraph.
SUBSCRIPTED = r"([a-zA-Z])_\{?([a-zA-Z0-9]+)\}?"
LATEX_EXPRESSION = r"\\(?:frac|sqrt|binom)\{[^}]+\}(?:\{[^}]+\})?"
LATEX_SYMBOL = r"\\(alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|phi|chi|psi|omega|infty|cdot|times|pm)"
VARIABLE = r"(?:^|[\s=+\-*/^({,<>])([a-zA-Z])(?=[\s=+\-*/^)},.<>:\d]|$|\^|_)"
NUMBER = r"(?<![a-zA-Z])(\d{2,}(?:\.\d+)?|\d+\.\d+)(?![a-zA-Z])"
NOT_VARIABLES = ["a", "i", "I", "A"]

# Penalties of dead steps.
PENALTY = {
    "verification_theater": 0.80,
    "circular_revisit": 0.60,
    "wasteful_exploration": 0.40,
    "failed_correction": 0.30,
    "abandoned_computation": 0.30,
    "generic_dead": 0.30,
    "redundant_verification": 0.20,
    "productive_dead_end": 0.05,
}

# Words that open and close a span of verification in cleaned solutions.
VERIFY_KEYWORDS = [
    "let me verify", "let me check", "let me double-check", "let me double check", "let's verify", "let's check", "let's double-check", "let's double check",
    "to verify", "to check", "to confirm", "i can verify", "i can check", "i'll verify", "i'll check", "we can verify", "we can check",
    "double-checking", "double checking", "verification:", "checking:", "let me make sure", "let's make sure", "sanity check",
]

# Signals of a paragraph that carries the key step.
HINT_MATH = ["=", r"\frac", r"\sqrt", r"\cos", r"\sin", r"\cdot"]
HINT_TECHNIQUE = [
    "apply", "using", "by the", "theorem", "formula", "identity", "substitut", "factor", "expand", "simplif", "rewrite", "note that", "observe", "notice", "key", "trick",
    "insight", "let us", "consider", "define", "recall", "since", "vieta", "binomial", "modular", "pigeonhole", "induction",
]
HINT_RESTATEMENT = ["we are given", "the problem states", "we need to find", "we want to find"]
HINT_DEFAULT = "Think about what mathematical technique or identity might simplify this."
# fmt: on
# fmt: off
# What a line starts with that ends a removed span of verification.
NEW_TOPIC = [
    "Step", "Now", "Next", "First", "Second", "Third", "Then", "Finally", "Therefore", "Thus", "Hence", "So ", "Since", "Given", "We ", "The ", "From",
    "**Step", "**Now", "**Next",
]
# fmt: on
#: Prompts of training records, of guided generation and of hints.
SYSTEM_PROMPT = "Please reason step by step, and put your final answer within \\boxed{}."
CHOICE_PROMPT = "Please provide your answer as a single letter (A, B, C, or D) in \\boxed{}."
STRUCTURAL_PREFIX = "Solve this problem step by step. Be efficient: avoid re-deriving results you already established, avoid verifying intermediate results that won't be used in your final answer, and if an approach leads to a dead end after 2-3 steps, abandon it and try another. Put your final answer in \\boxed{}.\n\n"
STRUCTURAL_SYSTEM = "You are a precise mathematical reasoner. Focus on productive reasoning steps that directly contribute to the solution. Avoid verification theater (checking work that won't affect the answer), dead cascades (long chains of reasoning that don't connect to the conclusion), and circular revisits (re-deriving things you already proved)."
HINT_REQUEST = "I tried to solve this problem but got it wrong multiple times. Can you give me a brief hint about what approach or technique to use? Don't solve it, just give a hint.\n\nProblem: "
REFLECTION_START = "I tried to solve this problem and got these wrong answers: "
REFLECTION_END = "\n\nWhat key insight or technique am I missing? Give me a brief hint about the correct approach (don't solve it)."
HINT_GIVEN = "Here's a hint that might help: "
HINT_REFLECTED = "Hint from reflection: "
#: Policies of the cleaned variants.
POLICIES = {"original": "Remove nothing", "liveverif": "Remove dead verification only", "dse": "Remove ALL dead steps", "noverif": "Remove ALL verification (dead+live)", "keywordclean": "Remove verif keyword spans (heuristic)"}
