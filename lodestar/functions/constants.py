"""Fixed values that must equal the behaviour being reproduced.

FIXED VALUES: the word lists below are data, written out in their natural
order. Do not edit them to "tidy up": results depend on them verbatim.
"""

# FIXED VALUES: general stop words removed by the keyword filter (74 words).
GENERAL_STOP_WORDS = (
    "is a the and or of to in it that this for what can be an are do does did "
    "have has had was were will how why when where which who with as at by from "
    "if into like near on onto out over past than then through under until up "
    "upon without you your i me my we our us he him his she her they them their "
    "list describe main give"
).split()

# FIXED VALUES: generic medical words removed by the keyword filter (47 words).
MEDICAL_STOP_WORDS = (
    "disease disorder syndrome patient study analysis results review case report "
    "effect treatment therapy clinical trial evidence role mechanism approach "
    "management association factor risk level group use related potential impact "
    "efficacy safety comparison development evaluation assessment status marker "
    "expression pathway interaction cell gene protein receptor inhibitor agonist "
    "antagonist"
).split()

# FIXED VALUES: the public 318-word English stop list used by the TF-IDF
# tokeniser (scikit-learn's "english" list), alphabetical as published.
TFIDF_STOP_WORDS = (
    "a about above across after afterwards again against all almost alone along "
    "already also although always am among amongst amoungst amount an and another "
    "any anyhow anyone anything anyway anywhere are around as at back be became "
    "because become becomes becoming been before beforehand behind being below "
    "beside besides between beyond bill both bottom but by call can cannot cant co "
    "con could couldnt cry de describe detail do done down due during each eg eight "
    "either eleven else elsewhere empty enough etc even ever every everyone "
    "everything everywhere except few fifteen fifty fill find fire first five for "
    "former formerly forty found four from front full further get give go had has "
    "hasnt have he hence her here hereafter hereby herein hereupon hers herself him "
    "himself his how however hundred i ie if in inc indeed interest into is it its "
    "itself keep last latter latterly least less ltd made many may me meanwhile "
    "might mill mine more moreover most mostly move much must my myself name namely "
    "neither never nevertheless next nine no nobody none noone nor not nothing now "
    "nowhere of off often on once one only onto or other others otherwise our ours "
    "ourselves out over own part per perhaps please put rather re same see seem "
    "seemed seeming seems serious several she should show side since sincere six "
    "sixty so some somehow someone something sometime sometimes somewhere still "
    "such system take ten than that the their them themselves then thence there "
    "thereafter thereby therefore therein thereupon these they thick thin third "
    "this those though three through throughout thru thus to together too top "
    "toward towards twelve twenty two un under until up upon us very via was we "
    "well were what whatever when whence whenever where whereafter whereas whereby "
    "wherein whereupon wherever whether which while whither who whoever whole whom "
    "whose why will with within without would yet you your yours yourself "
    "yourselves"
).split()

# FIXED VALUES: prefixes stripped from a rewritten query, in this order.
QUERY_PREFIXES = (
    "Optimized PubMed Query String:",
    "Optimized PubMed Query:",
    "PubMed Query:",
    "Query:",
)

# FIXED VALUES: output formats and defaults of the pipeline.
DOC_URL_PREFIX = "http://www.ncbi.nlm.nih.gov/pubmed/"
# the extractor label every metric file carries, whatever extractor ran
METRIC_FILE_EXTRACTOR = "LLM Gemini"
NOT_AVAILABLE = "N/A"
DETAILS_UNAVAILABLE = "[Details unavailable]"
TITLE_ABSTRACT_NA = "[Title/Abstract N/A]"
MAX_SNIPPET_LEN = 250
TOP_N = 10
MAX_SEARCH_RESULTS = 500
CORE_TERMS = 1
WEIRDNESS_THRESHOLD = 10.0
OOV_WEIRDNESS = 0.1
FALLBACK_TOP_WORDS = 3
EXPANSION_TOP_N = 3

# FIXED VALUES: ranking-function parameters (BM25 Okapi defaults, TF-IDF cap).
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
TFIDF_MAX_FEATURES = 5000

RANKERS = ("TF-IDF", "BM25", "EMBEDDING")
QUERY_MODES = ("BODY", "KEYWORDS", "BODY + KEYWORDS")
METRIC_COLUMNS = ("S@10", "P@10", "R@10", "F1@10", "MAP@10", "MRR", "NDCG@10")

# FIXED VALUES: patterns and characters of the stored-response formats and of
# document addresses.
STRING_LITERAL_RE = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
LIST_RE = r"(?s)(\[.*?\])"
PIECE_SPLIT_RE = r"[,\n]"
PIECE_TRIM = "'\"[] "
URL_ID_RE = r"([0-9]+)/?$"
# Escapes of a string literal with a meaning of their own.
LITERAL_ESCAPES = {"\\n": "\n", "\\t": "\t", "\\r": "\r"}
