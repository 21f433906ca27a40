"""Values that have to be the same everywhere a rating is asked for, sent or stored.

Everything in this module is a fixed value: wire names, sentinels, prompts and
provider options.  Changing one changes results.
"""

# --- scores -----------------------------------------------------------------
# The marker an answer wraps its score in, and the score that
# stands for "no score could be read".
SCORE_MARKER = "!$*_&"
FAILED_SCORE = -999.0

# --- rating -----------------------------------------------------------------
# Model names a request may use, and the result texts of a failed
# call and of the stub.
KNOWN_MODELS = ("gpt", "claude", "gemini")
DEFAULT_MODEL = "gpt"
DEFAULT_TEMPERATURE = 0.0
FAILED_RATING_TEXT = "Error processing article."
STUB_RATING_TEXT = "dummy working"

# --- sources ----------------------------------------------------------------
# Fixed values: (text looked for in the URL, source), tried in this order, and
# the (element, class) whose blocks hold the article of each source.
SOURCE_PATTERNS = (
    ("cnn.com", "cnn"),
    ("foxnews.com", "foxnews"),
    ("abcnews.go.com", "abcnews"),
)
STRICT_SOURCE_PATTERNS = (
    ("www.cnn.com", "cnn"),
    ("www.foxnews.com", "foxnews"),
    ("abcnews.go.com", "abcnews"),
)
UNKNOWN_SOURCE = "unknown"
CONTAINER_CLASSES = {
    "cnn": "article__content-container",
    "foxnews": "article-body",
}

# --- topics -----------------------------------------------------------------
# Topic and consumer-group names.
ARTICLES_TOPIC = "news_articles"
RESULTS_TOPIC = "processed_news_results"
ARTICLES_GROUP = "article_processing"
RESULTS_GROUP = "rated_articles"

# --- answers ----------------------------------------------------------------
# Texts of acknowledgements and errors.
NO_URL = "No URL provided"
NO_CONTENT = "No content extracted from the article"
TIMED_OUT = "Request timed out"
FETCH_FAILED = "Failed to fetch URL: "
ACCEPTED = "Article sent for processing"
UNKNOWN_MODEL = "cannot unpack non-iterable NoneType object"
INTERNAL_ERROR = "Internal Server Error"

# --- provider options -------------------------------------------------------
# What each provider call is given.  ``temperature`` says whether
# the request's temperature is passed on.
SYNC_OPTIONS = {
    "gpt": {"provider_model": "gpt-4o", "top_p": 1.0, "n": 1, "temperature": True},
    "claude": {"provider_model": "claude-3-5-sonnet-20240620", "max_tokens": 1000, "temperature": True},
    "gemini": {"provider_model": "gemini-1.5-flash", "temperature": True},
}
STREAM_OPTIONS = {
    "gpt": {"provider_model": "gpt-4o", "temperature": True},
    "claude": {"provider_model": "claude-3-5-sonnet-20240620", "max_tokens": 1000, "temperature": True},
    "gemini": {"provider_model": "gemini-1.5-flash", "temperature": False},
}

# --- prompts ----------------------------------------------------------------
# Prompt texts, white space included; {content} marks the place
# of the article.
PROMPTS = {
    "detailed": '''
    You are an AI trained to evaluate political bias in news articles. 

    Please analyze the news content below and give a political bias score based on the content. Do not consider the source or any other context, only the content itself.

    1. Explanation: explain the reasoning in bullet points. Be objective, and logical in your explanation.

    2. Bias Score: Based on the explanation, provide a score between -2 and 2:
       - -2 = Far-left bias
       - 2 = Far-right bias
       - 0 = Neutral (no bias)
       Please wrap the score between !$*_& sign like this !$*_&score!$*_&

    Here is the news content:
    """{content}"""

    Please evaluate the content and output only the score following the reasons. Do not use any formatting like **.
    ''',
    "detailed_legacy": '''
    You are an AI trained to evaluate political bias in news articles. 
    
    Please analyze the news content below and give a political bias score based on the content. Do not consider the source or any other context, only the content itself.
    
    1. Explanation: explain the reasoning in bullet points. Be objective, and logical in your explanation.
    
    2. Bias Score: Based on the explanation, provide a score between -2 and 2:
       - -2 = Far-left bias
       - 2 = Far-right bias
       - 0 = Neutral (no bias)
       Please wrap the score between !$*_& sign like this !$*_&score!$*_&
       
    
    Here is the news content:
    """{content}"""
    
    Please evaluate the content and output only the score following the reasons. Do not use any formatting like **.
    
    ''',
    "brief": '''
    You are an AI trained to evaluate political bias in news articles. 
    
    Please analyze the news content below and give a political bias score based on the content only.

    1. Explanation: Explain the reasoning in bullet points.
    2. Bias Score: Provide a score between -2 and 2:
       - -2 = Far-left bias
       - 2 = Far-right bias
       - 0 = Neutral
       Wrap the score with !$*_& like this: !$*_&score!$*_&

    Here is the news content:
    """{content}"""
    ''',
    "strict_format": (
        "carefully evaluate that whether this content political is biased?"
        "Don't consider the source of the news. pretend you don't know about it."
        "output -2~2 from far left to far right political biased, 0 for non-biased"
        "Please output in this format, strictly:"
        "Score: score"
        "Reasons: (in short bullet point)"
        "{content}"
    ),
}
