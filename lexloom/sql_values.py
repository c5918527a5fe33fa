"""Values that the SQL states for itself, apart from the library's own: word lists, patterns, constants.

Fixed values, all of them; a value that is wrong in one place only makes a query and its SQL differ.
"""

from __future__ import annotations

RETRIEVAL_STOP = """the and or of to a an is was with under on in for by act alleged case concerns conduct continued date from happened incident involved january february march april may
june july august september october november december offence offense occurred place took until his her their its it which law section apply""".split()
KEYWORD_STOP = """about after against also been being from have into offence person provisions section shall such that their there these they this under where which whoever with would""".split()
ENGLISH_STOP = """the a an and or of to in on at by for with from is are was were be been it this that these those as i my me we our you your he she they his her their its under which who
whom his him them has have had do does did will would can could may might shall should there here""".split()
ENGLISH_NEGATIONS = """not no without never none nor cannot""".split()
VOCABULARY = """theft movable dishonest dishonestly property take took taking taken takes moved moves stolen steal steals stealing stole murder homicide killing mob lynching cheating
cheated defraud defrauded defrauding defrauds fraud fraudulent fraudulently trick tricked unjustly unfairly unfaithfully treasonfully disloyalty deceive deceived
deceiving deception deceptive induce induced induces inducement deliver delivered delivering delivers delivery transfer transferred transferring transfers sell sold
selling give gave giving hand handed sedition sovereignty unity integrity organized crime syndicate continuing unlawful state threat assault assaulted attack attacked
beat beaten hit struck blow physical hurt hurts injure injured injures injury injuries grievous serious seriously bodily pain wound wounded""".split()
MONTHS = """january february march april may june july august september october november december""".split()
MONTHS_SHORT = """jan feb mar apr may jun jul aug sep oct nov dec""".split()
PHRASE_NOISE = """section sections sec rupees rupee rs inr ipc bns bnss crpc""".split()
ENGLISH_SUFFIXES = ('edly', 'ing', 'ed', 'es', 's')
OFFENCE_HINTS = ('offense', 'offence', 'crime', 'act', 'incident', 'conduct', 'committed', 'happened', 'took place')
CONTINUING = r"\b(continued|continuing|ongoing|from|between|until|through|spanning|completed after|started before)\b"
UNDECIDED = r"\b(continued|continuing|until|through|between|spanning)\b"
CUTOFF = '2024-07-01'
DIGIT_BLOCKS = (0x966, 0xae6, 0x660, 0x6f0, 0x9e6, 0xa66, 0xb66, 0xbe6, 0xc66, 0xce6, 0xd66)
SCRIPT_BLOCKS = (
    ('gujarati', r"[\x{0A80}-\x{0AFF}]"),
    ('arabic', r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]"),
    ('devanagari', r"[\x{0900}-\x{097F}]"),
    ('latin', r"[A-Za-z]"),
)
PHRASES = (
    ('movable property', r"\bmovable\s+property\b"),
    ('mobile phone', r"\bmobile\s+phone\b"),
    ('phone property', r"\b(?:(?:mobile|cell(?:ular)?|smart)\s*)?phones?\b"),
    ('dishonestly induced', r"\bdishonestly\s+induc(?:e|ed|es|ing|ement)\b"),
    ('deliver property', r"\bdeliver(?:s|ed|ing|y)?\s+(?:any\s+)?property\b"),
    ('give property', r"\b(?:giv(?:e|es|ing)|gave)\s+(?:(?:him|her|them|a\s+person|someone)\s+)?(?:false\s+|any\s+)?property\b"),
    ('hand over property', r"\bhand(?:ed)?\s+over\s+(?:any\s+)?property\b"),
    ('transfer property', r"\btransfer(?:s|red|ring)?\s+(?:any\s+)?property\b"),
    ('sell property', r"\bs(?:ell|old|elling)\s+(?:any\s+)?property\b"),
    ('delivery of property', r"\b(?:caused\s+|resulted\s+in\s+)?delivery\s+of\s+(?:any\s+)?property\b"),
    ('deceived person', r"\b(?:person\s+was\s+deceived|deceived\s+(?:a\s+)?person|person\s+deceived)\b"),
    ('tricked person', r"\b(?:person\s+was\s+tricked|tricked\s+(?:a\s+)?person|person\s+tricked)\b"),
    ('deceived into property transfer', r"\b(?:deceived|tricked|seduced|defrauded?)\s+(?:a\s+)?person\s+into\s+(?:giv(?:e|ing)|hand(?:ing)?\s+over|deliver(?:ing)?|transfer(?:ring)?|sell(?:ing)?)\s+(?:any\s+)?property\b"),
    ('led to property transfer', r"\b(?:led|induced|persuaded|caused|made|forced)\s+(?:him|her|them|a\s+person|person|someone)?\s*(?:to\s+)?(?:give|hand\s+over|deliver|transfer|sell)\s+(?:(?:him|her|them|a\s+person|someone)\s+)?(?:false\s+|any\s+)?property\b"),
    ('without consent', r"\bwithout\s+(?:the\s+)?(?:(?:someone|somebody|anyone|anybody)\s+else[\x{27}\x{2019}]s\s+|(?:another|that)\s+person[\x{27}\x{2019}]s\s+|[a-z][a-z0-9]*[\x{27}\x{2019}]s\s+|(?:his|her|their|its)\s+)?consent\b"),
    ('without permission', r"\bwithout\s+(?:the\s+)?(?:(?:someone|somebody|anyone|anybody)\s+else[\x{27}\x{2019}]s\s+|(?:another|that)\s+person[\x{27}\x{2019}]s\s+|[a-z][a-z0-9]*[\x{27}\x{2019}]s\s+|(?:his|her|their|its)\s+)?permission\b"),
    ('out of possession', r"\bout\s+of\s+(?:(?:another|that)\s+person[\x{27}\x{2019}]s\s+|[a-z][a-z0-9]*[\x{27}\x{2019}]s\s+|(?:his|her|their|its)\s+)?possession\b"),
    ('from possession', r"\bfrom\s+(?:(?:another|that)\s+person[\x{27}\x{2019}]s\s+|[a-z][a-z0-9]*[\x{27}\x{2019}]s\s+|(?:his|her|their|its)\s+)?possession\b"),
    ('victim property stolen', r"\b(?:(?:my|our|his|her|their|victim[\x{27}\x{2019}]s|complainant[\x{27}\x{2019}]s)\s+(?:[a-z]+\s+){1,3}(?:was|were|got)\s+stolen|got\s+(?:my|our|his|her|their|victim[\x{27}\x{2019}]s|complainant[\x{27}\x{2019}]s)\s+(?:[a-z]+\s+){1,4}stolen)\b"),
    ('seriously injured', r"\bseriously\s+injur(?:e|ed|es|ing)\b"),
    ('serious injury', r"\bserious\s+injur(?:y|ies)\b"),
    ('grievous hurt', r"\bgrievous\s+hurt\b"),
    ('caused hurt', r"\b(?:voluntarily\s+)?caus(?:e|ed|es|ing)\s+(?:bodily\s+)?hurt\b"),
    ('caused injury', r"\b(?:caus(?:e|ed|es|ing)|inflict(?:ed|s|ing)?|seriously\s+injur(?:e|ed|es|ing))\s+(?:serious\s+|bodily\s+|grave\s+|grievous\s+)?injur(?:y|ies|e|ed|es|ing)\b"),
    ('physical injury', r"\b(?:physical|bodily)\s+injur(?:y|ies|e|ed|es|ing)\b"),
    ('physical harm', r"\b(?:caus(?:e|ed|es|ing)\s+)?(?:physical|bodily)\s+harm\b"),
    ('bodily pain', r"\bbodily\s+pain\b"),
)
ENGLISH_MARKERS = r"(?i)\b(?:the|on|of|a|person|theft|cheating|offence|offense|happened|property|under|consent|law|act|IPC|BNS)\b"
SCRIPTS = {'hi': '0900-097F', 'mr': '0900-097F', 'gu': '0A80-0AFF', 'bn': '0980-09FF', 'ta': '0B80-0BFF', 'te': '0C00-0C7F', 'kn': '0C80-0CFF', 'ml': '0D00-0D7F', 'pa': '0A00-0A7F', 'ur': '0600-06FF'}
PATTERNS = (
    r"\b(20[0-9]{2})[-/.](0?[1-9]|1[0-2])[-/.](0?[1-9]|[12][0-9]|3[01])\b",
    r"\b(0?[1-9]|[12][0-9]|3[01])[-/.](0?[1-9]|1[0-2])[-/.](20[0-9]{2})\b",
    r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+([0-3]?[0-9]),?\s+(20[0-9]{2})\b",
    r"(?i)\b([0-3]?[0-9])\s+(january|february|march|april|may|june|july|august|september|october|november|december),?\s+(20[0-9]{2})\b",
)
GROUPS = ((1, 2, 3), (3, 2, 1), (3, 1, 2), (3, 2, 1))
