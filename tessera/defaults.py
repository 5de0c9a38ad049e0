"""Small default dictionaries, all overridable by passing a DataFrame.

Two kinds of values live here:
  * our own defaults (stop words, sentiment lexicon): hand-written, small,
    meant to be replaced by a real lexicon table in production;
  * fixed values that must equal the behaviour being reproduced (alias
    table, canned answers, keyword lists, message texts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for matching results).
# Alias table: lower-cased question -> search title.
ALIASES = [
    ("potus", "President of the United States"),
    ("us", "United States"),
    ("uk", "United Kingdom"),
]

# Canned answers: lower-cased, alias-expanded question -> answer.
CANNED_ANSWERS = [
    ("seven wonders of the world",
     "The Seven Wonders of the Ancient World are: 1. Great Pyramid of Giza, 2. Hanging Gardens of "
     "Babylon, 3. Statue of Zeus at Olympia, 4. Temple of Artemis at Ephesus, 5. Mausoleum at "
     "Halicarnassus, 6. Colossus of Rhodes, 7. Lighthouse of Alexandria."),
    ("how many planets are there in the solar system",
     "There are eight planets in the Solar System: Mercury, Venus, Earth, Mars, Jupiter, Saturn, "
     "Uranus, and Neptune."),
]

# Keywords that mark a sentence as relevant to a fact question (substring
# match on the lower-cased sentence; entries with capitals never match).
FACT_KEYWORDS = [
    "current", "since", "incumbent", "served as", "is the", "president", "head of state", "leader",
    "general election", "election results", "capital city", "famous", "record", "population",
    "landmark", "historical event", "personality",
    "parliamentary elections", "presidential elections", "elections", "electoral college",
    "world war 1", "world war 2",
    "war memorial", "sacrificial memorial", "revolution", "global warming", "winning elections",
    "election results",
    "achievement", "tourist attraction", "natural wonder", "industry", "cultural festival",
    "population", "top five", "top ten",
    "national holiday", "invention", "river", "mountain", "university", "ancient ruin",
    "prominent artist", "renowned scientist", "influential book", "classic movie", "popular cuisine",
    "traditional music", "continents", "oceans", "countries", "major cities", "lakes", "deserts",
    "islands", "valleys", "climates", "historical figures", "wars", "battles", "empires",
    "revolutions",
    "discoveries", "dynasties", "archaeological sites", "timelines", "ancient civilizations",
    "planets",
    "stars", "galaxies", "black holes", "theories", "elements", "compounds", "reactions",
    "physics concepts",
    "chemistry concepts", "biology concepts", "languages", "religions", "traditions", "festivals",
    "music",
    "dance", "art", "literature", "fashion", "architecture", "governments", "political leaders",
    "constitutions",
    "elections", "political parties", "treaties", "laws", "policies", "organizations", "markets",
    "currencies",
    "trade", "industries", "companies", "economists", "economic theories", "resources", "GDP",
    "inflation",
    "computers", "internet", "software", "hardware", "innovations", "programming languages",
    "gadgets", "networks",
    "cybersecurity", "AI and machine learning", "sports teams", "athletes", "championships",
    "events", "rules",
    "history of sports", "sports venues", "training methods", "movies", "TV shows", "celebrities",
    "awards",
    "genres", "directors", "actors", "music bands", "albums", "concerts",
]

# Keywords used when correcting an answer after negative feedback.
CORRECTION_KEYWORDS = ["current", "since", "incumbent", "served as"]

NO_BETTER_ANSWER = "Sorry, I couldn't find a better answer."
NO_CONTEXT_ERROR = "No context available. Please upload a document or scrape a website first."
GENERAL_PROMPT = "Answer the following question factually and concisely:\nQuestion: {question}\nAnswer:"
CONTEXT_PROMPT = ("The following is an excerpt from a website:\n\n{context}\n\nBased on this, provide a "
                  "concise and factual answer to the following question:\nQuestion: {question}\nAnswer:")
CLARIFY_MESSAGE = "I'm not sure about the answer. Can you please provide more details or clarify your question?"
CONFIDENCE_THRESHOLD = 0.7
TEXT_BUDGET = 1024          # characters scored / summarised
QA_CONTEXT_BUDGET = 1000    # characters of context given to QA
SUMMARY_TOKEN_BUDGET = 100  # maximum summary length in words
WORDCLOUD_MAX_WORDS = 200
COLLOCATION_THRESHOLD = 30.0
HISTOGRAM_BINS = 10
SAMPLE_EXAMPLES = 3
PREVIEW_ROWS = 5
QUESTION_SPEAKER = "Human 2:"
ANSWER_SPEAKER = "Human 1:"
EVAL_FRACTION = 0.1
# VADER constants (Hutto & Gilbert, 2014).
VADER_BOOST = 0.293
VADER_CAPS = 0.733
VADER_NEGATE = -0.74
VADER_EXCLAIM = 0.292
VADER_QUESTION = 0.18
VADER_ALPHA = 15.0
# ---------------------------------------------------------------------------

# Our own stop-word list (English function words).
STOP_WORDS = sorted(set("""
a about above after again against all am an and any are as at be because been before being
below between both but by can could did do does doing down during each few for from further had
has have having he her here hers herself him himself his how i if in into is it its itself just
me more most my myself no nor not now of off on once only or other our ours ourselves out over own
same she should so some such than that the their theirs them themselves then there these they this
those through to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves also us get got may might must shall let
""".split()))

# Our own small sentiment lexicon: token, valence (-4..4), polarity (-1..1),
# subjectivity (0..1).  Hand-written; replace with a full lexicon table.
LEXICON_WORDS = [
    ("good", 1.9, 0.7, 0.6), ("great", 3.1, 0.8, 0.75), ("excellent", 2.7, 1.0, 1.0),
    ("amazing", 2.8, 0.6, 0.9), ("wonderful", 2.7, 1.0, 1.0), ("best", 3.2, 1.0, 0.3),
    ("love", 3.2, 0.5, 0.6), ("like", 1.5, 0.0, 0.0), ("happy", 2.7, 0.8, 1.0),
    ("nice", 1.8, 0.6, 1.0), ("fine", 0.8, 0.4, 0.5), ("beautiful", 2.9, 0.85, 1.0),
    ("helpful", 1.8, 0.5, 0.5), ("useful", 1.9, 0.3, 0.0), ("clear", 1.6, 0.1, 0.38),
    ("correct", 1.5, 0.0, 0.0), ("success", 2.7, 0.3, 0.3), ("win", 2.8, 0.8, 0.4),
    ("perfect", 2.7, 1.0, 1.0), ("fantastic", 2.6, 0.4, 0.9), ("brilliant", 2.8, 0.9, 1.0),
    ("thanks", 1.9, 0.2, 0.2), ("thank", 1.5, 0.2, 0.2), ("glad", 2.0, 0.5, 1.0),
    ("enjoy", 2.2, 0.4, 0.5), ("fun", 2.3, 0.3, 0.2), ("easy", 1.9, 0.43, 0.83),
    ("strong", 2.3, 0.43, 0.73), ("positive", 2.6, 0.23, 0.55), ("safe", 1.9, 0.5, 0.5),
    ("bad", -2.5, -0.7, 0.67), ("terrible", -2.1, -1.0, 1.0), ("awful", -2.0, -1.0, 1.0),
    ("horrible", -2.5, -1.0, 1.0), ("worst", -3.1, -1.0, 1.0), ("hate", -2.7, -0.8, 0.9),
    ("sad", -2.1, -0.5, 1.0), ("angry", -2.3, -0.5, 1.0), ("poor", -2.1, -0.4, 0.6),
    ("wrong", -2.1, -0.5, 0.9), ("fail", -2.5, -0.5, 0.3), ("failure", -2.3, -0.3, 0.3),
    ("problem", -1.7, -0.2, 0.2), ("error", -1.7, -0.2, 0.2), ("broken", -1.8, -0.4, 0.4),
    ("ugly", -2.3, -0.7, 1.0), ("boring", -1.3, -1.0, 1.0), ("useless", -1.8, -0.5, 0.2),
    ("annoying", -1.7, -0.8, 0.9), ("weak", -1.9, -0.38, 0.5), ("negative", -2.7, -0.3, 0.4),
    ("dangerous", -2.1, -0.6, 0.9), ("sorry", -0.3, -0.5, 1.0), ("kill", -3.7, -0.2, 0.0),
    ("scum", -3.4, -0.8, 0.9), ("idiot", -2.3, -0.8, 1.0), ("trash", -2.7, -0.6, 0.8),
    ("worthless", -1.9, -0.8, 0.9), ("moron", -2.2, -0.8, 1.0), ("pathetic", -2.9, -1.0, 1.0),
    ("loser", -2.4, -0.5, 0.7), ("stupid", -2.4, -0.8, 1.0), ("disgusting", -2.4, -1.0, 1.0),
    ("clown", -0.8, -0.3, 0.5), ("dumb", -2.3, -0.4, 0.5), ("liar", -2.3, -0.6, 0.8),
]
NEGATIONS = [
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "cannot",
    "without", "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "can't",
    "couldn't", "won't", "wouldn't", "shouldn't", "hasn't", "haven't", "hadn't", "ain't",
    "isnt", "arent", "wasnt", "werent", "dont", "doesnt", "didnt", "cant", "couldnt", "wont", "wouldnt",
    "shouldnt", "hasnt", "havent", "hadnt", "aint", "mustnt", "neednt", "rarely", "seldom", "despite",
]
# token, VADER scalar (+ increases, - decreases), polarity/subjectivity multiplier
BOOSTERS = [
    ("very", VADER_BOOST, 1.3), ("really", VADER_BOOST, 1.3), ("extremely", VADER_BOOST, 1.5),
    ("absolutely", VADER_BOOST, 1.4), ("totally", VADER_BOOST, 1.3), ("incredibly", VADER_BOOST, 1.5),
    ("so", VADER_BOOST, 1.2), ("too", VADER_BOOST, 1.2), ("most", VADER_BOOST, 1.3),
    ("completely", VADER_BOOST, 1.4), ("highly", VADER_BOOST, 1.3), ("utterly", VADER_BOOST, 1.5),
    ("slightly", -VADER_BOOST, 0.7), ("somewhat", -VADER_BOOST, 0.8), ("barely", -VADER_BOOST, 0.6),
    ("hardly", -VADER_BOOST, 0.6), ("marginally", -VADER_BOOST, 0.7), ("partly", -VADER_BOOST, 0.8),
]

LEXICON_SCHEMA = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),          # word | negation | booster
    T.StructField("valence", T.DoubleType(), True),
    T.StructField("polarity", T.DoubleType(), True),
    T.StructField("subjectivity", T.DoubleType(), True),
    T.StructField("boost", T.DoubleType(), True),
    T.StructField("intensity", T.DoubleType(), True),
])


def lexicon_rows() -> list[tuple]:
    rows = [(w, "word", v, p, s, None, None) for w, v, p, s in LEXICON_WORDS]
    rows += [(w, "negation", None, None, None, None, None) for w in NEGATIONS]
    rows += [(w, "booster", None, None, None, b, i) for w, b, i in BOOSTERS]
    return rows


def lexicon_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lexicon_rows(), LEXICON_SCHEMA)


def stop_words_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")


def aliases_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "alias string, title string")


def canned_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CANNED_ANSWERS, "question string, answer string")


def keywords_df(spark: SparkSession, keywords=None) -> DataFrame:
    kws = FACT_KEYWORDS if keywords is None else keywords
    return spark.createDataFrame([(k,) for k in kws], "keyword string")
