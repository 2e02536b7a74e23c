"""Fixed values.

Word lists, query templates, slug tables and text formats that decide results.
They are data, not logic: a run only gives the expected scores, queries and
report lines when these values are exactly these.  Every function that uses one
takes it as a parameter, so a caller can supply other lists.
"""

# --- fixed values: scoring lexicons ------------------------------------------

PAIN_TERMS = [
    "frustrat", "hate", "wish", "terrible", "awful", "slow", "expensive",
    "inconsisten", "artifact", "broken", "waste", "painful", "annoying",
    "disappoint", "useless", "garbage", "horrible", "unusable", "buggy",
    "overpriced", "scam", "misleading", "workaround", "hack", "tedious",
    "clunky", "unreliable", "laggy", "crash", "glitch",
]

DEMAND_TERMS = [
    "pay for", "would pay", "need a tool", "wish there was",
    "someone should build", "is there a", "looking for",
    "alternative to", "shut up and take my money", "i'd pay",
    "take my money", "does anyone know", "am i the only one",
]

# --- fixed values: words that never count as topic words -----------------------

STOP_WORDS = [
    "a", "an", "the", "and", "or", "for", "of", "to", "in", "on", "with",
    "is", "are", "was", "were", "be", "been", "being", "that", "this",
    "it", "its", "my", "your", "our", "their", "what", "how", "why",
]

# --- fixed values: search templates, {topic} is replaced ------------------------

HN_COMMENT_TEMPLATES = [
    "{topic} frustrating",
    "{topic} problem",
    "{topic} limitation",
    "{topic} workflow slow",
    "{topic} expensive",
    "{topic} inconsistent",
    "{topic} disappointing",
    "{topic} workaround",
    "wish {topic} could",
    "need {topic} tool",
    "{topic} alternative",
    "{topic} pain point",
]

HN_STORY_TEMPLATES = [
    "{topic}",
    "{topic} tool",
    "{topic} generation",
    "{topic} open source",
]

# Boolean templates: the topic as a phrase and at least one of the alternatives.
REDDIT_TEMPLATES = [
    ('"{topic}" ("I wish" OR "is there a tool" OR "frustrating")',
     ["I wish", "is there a tool", "frustrating"]),
    ('"{topic}" ("I\'d pay for" OR "someone should build" OR "workaround")',
     ["I'd pay for", "someone should build", "workaround"]),
    ('"{topic}" (complaint OR problem OR "waste of time")',
     ["complaint", "problem", "waste of time"]),
    ('"{topic}" (alternative OR "looking for" OR disappointing)',
     ["alternative", "looking for", "disappointing"]),
]

TWITTER_TEMPLATES = [
    ('"{topic}" (frustrating OR terrible OR hate OR broken)',
     ["frustrating", "terrible", "hate", "broken"]),
    ('"{topic}" ("wish there was" OR "someone should build" OR "need a tool")',
     ["wish there was", "someone should build", "need a tool"]),
    ('"{topic}" (expensive OR overpriced OR "would pay")',
     ["expensive", "overpriced", "would pay"]),
    ('"{topic}" (alternative OR workaround OR "looking for")',
     ["alternative", "workaround", "looking for"]),
]

# --- fixed values: topic word -> launch-site slugs -------------------------------

TOPIC_SLUGS = {
    "ai": ["artificial-intelligence", "ai", "machine-learning"],
    "video": ["video", "video-editing", "video-streaming"],
    "design": ["design-tools", "web-design", "graphic-design"],
    "developer": ["developer-tools", "open-source", "github"],
    "nocode": ["no-code", "low-code"],
    "saas": ["saas", "productivity", "software-engineering"],
    "marketing": ["marketing", "seo", "social-media-marketing"],
}
DEFAULT_SLUGS = ["tech", "artificial-intelligence", "developer-tools"]

# --- fixed values: platform labels and the URL fragments that show them ------------

PLATFORM_URL_MARKS = [
    ("hn", ["news.ycombinator.com", "hn_"]),
    ("reddit", ["reddit.com"]),
    ("producthunt", ["producthunt.com"]),
    ("twitter", ["twitter.com", "x.com"]),
    ("g2", ["g2.com"]),
    ("capterra", ["capterra.com"]),
]

# --- fixed values: text joined to a body when comments enrich it ---------------------

REDDIT_COMMENT_HEADER = "\n\n--- TOP COMMENTS ---\n"
REDDIT_COMMENT_SEPARATOR = "\n---\n"
LAUNCH_COMMENT_HEADER = "\n\n--- User Comments ---\n"
LAUNCH_COMMENT_SEPARATOR = "\n"

# --- fixed values: fields and categories of an extracted pain point --------------------

PAIN_CATEGORIES = [
    "missing_feature", "pricing", "workflow_friction",
    "integration_need", "quality_issue", "learning_curve",
]

# --- fixed values: named HTML entities the JVM path decodes ('&amp;' last) ---------------

COMMON_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"),
    ("&#x2F;", "/"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"),
    ("&amp;", "&"),
]

# --- fixed values: characters that separate words (Unicode white space) --------------------

SPACE_CLASS = (
    "\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
)

# --- fixed values: counter-evidence phrases ---------------------------------------------------

RESOLVED_TERMS = [
    "solved", "not a problem anymore", "fixed", "update", "workaround", "easy fix",
]
