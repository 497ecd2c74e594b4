"""Word lists, tag sets, alias tables and weights."""

# English stop words, lower case.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Penn tags that count as content words.
CONTENT_TAGS = "NN NNS NNP NNPS VB VBD VBG VBN VBP VBZ JJ JJR JJS RB RBR RBS".split()

# Dependency labels of subordinate clauses and of a coordinating conjunction.
SUBORDINATE_DEPS = ["advcl", "ccomp", "relcl"]
COORDINATOR_DEP = "cc"

# Closed-class words and their Penn tag, used before any suffix rule.
CLOSED_CLASS = {
    "DT": "the a an this that these those each every some any no".split(),
    "IN": "of in on at by for with from into over under about after before between through "
          "during against if because while although since unless until than as".split(),
    "CC": "and or but nor yet".split(),
    "PRP": "i you he she it we they me him us them".split(),
    "PRP$": "my your his her its our their".split(),
    "MD": "can could will would shall should may might must".split(),
    "TO": ["to"],
    "VBZ": "is has does".split(),
    "VBP": "are am have do".split(),
    "VBD": "was were had did".split(),
    "VB": ["be"],
    "WDT": ["which"],
    "WP": "who what whom".split(),
    "WRB": "when where why how".split(),
    "EX": ["there"],
    "RB": "not n't very too also then here now only".split(),
}

# Suffix -> tag, tried in this order on alphabetic words longer than the suffix by 2.
SUFFIX_TAGS = [("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("s", "NNS")]

# Metric columns fed to the classifier, in order.
METRICS = [
    "mean_sentence_length", "std_sentence_length", "lexical_density", "variance", "burstiness",
    "saliency", "sentiment", "sentiment_deviation", "depth", "head", "sub_clauses",
    "coord_clauses", "branching", "balanced",
]

# Numeric columns that the margin classifier standardises.
SCALED_METRICS = [
    "lexical_density", "variance", "burstiness", "saliency", "depth", "sentiment_deviation", "ttr",
]

# Language alias -> file extension; an unknown alias passes through.
EXTENSIONS = {
    "python": "py", "py": "py", "python3": "py", "cpp": "cpp", "c++": "cpp", "cc": "cpp",
    "javascript": "js", "js": "js", "node": "js", "typescript": "ts", "ts": "ts",
    "html": "html", "htm": "html", "css": "css", "bash": "sh", "shell": "sh", "java": "java",
    "gdscript": "cpp", "gd": "cpp", "c": "c", "rust": "rs", "rs": "rs", "ruby": "rb", "rb": "rb",
    "r": "r",
}

# Detected language -> extension; an unknown name is rejected.
KNOWN_EXTENSIONS = {
    "python": "py", "py": "py", "ipynb": "py", "c++": "cpp", "cpp": "cpp", "c-plus-plus": "cpp",
    "c": "c", "java": "java", "javascript": "js", "js": "js", "html": "html", "css": "css",
    "rust": "rust",
}

# Extensions accepted for source files.
CODE_EXTENSIONS = ["py", "ipynb", "cpp", "c", "java"]

# Valence rule weights (Hutto and Gilbert, ICWSM 2014).
BOOST = 0.293
CAPS_BOOST = 0.733
NEGATION = -0.74
DAMPING = [1.0, 0.95, 0.9]
EXCLAIM = 0.292
NORMALISER = 15.0
BOOSTERS_UP = """
absolutely amazingly awfully completely considerably decidedly deeply enormously entirely
especially exceptionally extremely fully greatly highly hugely incredibly intensely more most
particularly purely quite really remarkably so substantially thoroughly totally tremendously
unusually utterly very
""".split()
BOOSTERS_DOWN = "almost barely hardly less little marginally occasionally partly scarcely slightly somewhat".split()
NEGATIONS = """
aint ain't arent aren't cannot cant can't couldnt couldn't didnt didn't doesnt doesn't dont don't
hadnt hadn't hasnt hasn't havent haven't isnt isn't mightnt mightn't mustnt mustn't neednt needn't
neither never none nope nor not nothing nowhere shouldnt shouldn't wasnt wasn't werent weren't
without wont won't wouldnt wouldn't rarely seldom despite
""".split()

# A small default polarity lexicon; a full one is passed in as a table.
POLARITY = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "best": 3.2, "better": 1.9, "happy": 2.7,
    "love": 3.2, "like": 1.5, "nice": 1.8, "beautiful": 2.9, "win": 2.8, "hope": 1.9, "fun": 2.3,
    "help": 1.7, "strong": 2.3, "free": 2.3, "safe": 1.9, "true": 1.8, "rich": 2.6, "worth": 0.9,
    "bad": -2.5, "worse": -2.1, "worst": -3.1, "poor": -2.1, "sad": -2.1, "hate": -2.7,
    "ugly": -2.3, "lose": -1.3, "fear": -2.2, "pain": -2.3, "problem": -1.7, "wrong": -2.1,
    "weak": -1.9, "kill": -3.7, "war": -2.9, "worthless": -1.9, "fail": -2.5, "lost": -1.3,
}

# Irregular forms, (word, class) -> lemma.
LEMMA_EXCEPTIONS = [
    ("was", "v", "be"), ("were", "v", "be"), ("is", "v", "be"), ("are", "v", "be"),
    ("am", "v", "be"), ("been", "v", "be"), ("has", "v", "have"), ("had", "v", "have"),
    ("does", "v", "do"), ("did", "v", "do"), ("went", "v", "go"), ("said", "v", "say"),
    ("men", "n", "man"), ("women", "n", "woman"), ("children", "n", "child"),
    ("people", "n", "people"), ("feet", "n", "foot"), ("mice", "n", "mouse"),
    ("better", "a", "good"), ("best", "a", "good"), ("worse", "a", "bad"), ("worst", "a", "bad"),
]

# Suffix detachment per class, (class, suffix, replacement) in order of preference.
DETACHMENTS = [
    ("n", "s", ""), ("n", "ses", "s"), ("n", "xes", "x"), ("n", "zes", "z"), ("n", "ches", "ch"),
    ("n", "shes", "sh"), ("n", "men", "man"), ("n", "ies", "y"),
    ("v", "s", ""), ("v", "ies", "y"), ("v", "es", "e"), ("v", "es", ""), ("v", "ed", "e"),
    ("v", "ed", ""), ("v", "ing", "e"), ("v", "ing", ""),
    ("a", "er", ""), ("a", "est", ""), ("a", "er", "e"), ("a", "est", "e"),
]

# Marker words with weights, for naming the language of a text.
LANGUAGE_MARKERS = {
    "en": {"the": 2.0, "and": 2.0, "of": 1.0, "with": 1.0, "that": 1.0, "is": 1.0},
    "fr": {"le": 1.0, "les": 2.0, "des": 1.5, "et": 2.0, "une": 1.0, "est": 1.0, "dans": 1.0},
    "de": {"der": 2.0, "die": 1.5, "und": 2.0, "das": 1.5, "ist": 1.0, "nicht": 1.0},
    "es": {"el": 2.0, "los": 2.0, "y": 1.5, "que": 0.5, "una": 1.0, "para": 1.0, "por": 1.0},
}
