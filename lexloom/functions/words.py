"""Word lists and rule tables. All are small, fixed values of the language or of the domain."""

from __future__ import annotations

# Words that retrieval ignores.
RETRIEVAL_STOP = (
    "the and or of to a an is was with under on in for by act alleged case concerns conduct continued date from happened incident involved january february march april may june july august september "
    "october november december offence offense occurred place took until his her their its it which law section apply"
).split()

# Words that keyword lists leave out.
KEYWORD_STOP = "about after against also been being from have into offence person provisions section shall such that their there these they this under where which whoever with would".split()

# English function words, negations (kept, since they carry meaning), and inflections.
ENGLISH_STOP = (
    "the a an and or of to in on at by for with from is are was were be been it this that these those as i my me we our you your he she they his her their its under which who whom his him them has have had "
    "do does did will would can could may might shall should there here"
).split()
ENGLISH_NEGATIONS = "not no without never none nor cannot".split()
ENGLISH_SUFFIXES = ("edly", "ing", "ed", "es", "s")

# Words that are entities of other kinds and so delimit keyphrases.
PHRASE_NOISE = "section sections sec rupees rupee rs inr ipc bns bnss crpc".split()
MONTHS = "january february march april may june july august september october november december".split()
MONTHS_SHORT = "jan feb mar apr may jun jul aug sep oct nov dec".split()

# The domain's vocabulary, in its order.
VOCABULARY = (
    "theft movable dishonest dishonestly property take took taking taken takes moved moves stolen steal steals stealing stole murder homicide killing mob lynching cheating cheated defraud defrauded defrauding defrauds "
    "fraud fraudulent fraudulently trick tricked unjustly unfairly unfaithfully treasonfully disloyalty deceive deceived deceiving deception deceptive induce induced induces inducement deliver delivered delivering "
    "delivers delivery transfer transferred transferring transfers sell sold selling give gave giving hand handed sedition sovereignty unity integrity organized crime syndicate continuing unlawful state threat assault "
    "assaulted attack attacked beat beaten hit struck blow physical hurt hurts injure injured injures injury injuries grievous serious seriously bodily pain wound wounded"
).split()

# Whose consent, possession or property. The apostrophe is written by its code point, so that SQL can quote the patterns.
_ONES = r"(?:another|that)\s+person[\x{27}\x{2019}]s\s+|[a-z][a-z0-9]*[\x{27}\x{2019}]s\s+|(?:his|her|their|its)\s+"
_ANYONES = r"(?:someone|somebody|anyone|anybody)\s+else[\x{27}\x{2019}]s\s+|" + _ONES
_VICTIMS = r"(?:my|our|his|her|their|victim[\x{27}\x{2019}]s|complainant[\x{27}\x{2019}]s)"
# Labelled phrases; patterns that hold in every regular-expression dialect used here.
PHRASES = (
    ("movable property", r"\bmovable\s+property\b"),
    ("mobile phone", r"\bmobile\s+phone\b"),
    ("phone property", r"\b(?:(?:mobile|cell(?:ular)?|smart)\s*)?phones?\b"),
    ("dishonestly induced", r"\bdishonestly\s+induc(?:e|ed|es|ing|ement)\b"),
    ("deliver property", r"\bdeliver(?:s|ed|ing|y)?\s+(?:any\s+)?property\b"),
    ("give property", r"\b(?:giv(?:e|es|ing)|gave)\s+(?:(?:him|her|them|a\s+person|someone)\s+)?(?:false\s+|any\s+)?property\b"),
    ("hand over property", r"\bhand(?:ed)?\s+over\s+(?:any\s+)?property\b"),
    ("transfer property", r"\btransfer(?:s|red|ring)?\s+(?:any\s+)?property\b"),
    ("sell property", r"\bs(?:ell|old|elling)\s+(?:any\s+)?property\b"),
    ("delivery of property", r"\b(?:caused\s+|resulted\s+in\s+)?delivery\s+of\s+(?:any\s+)?property\b"),
    ("deceived person", r"\b(?:person\s+was\s+deceived|deceived\s+(?:a\s+)?person|person\s+deceived)\b"),
    ("tricked person", r"\b(?:person\s+was\s+tricked|tricked\s+(?:a\s+)?person|person\s+tricked)\b"),
    ("deceived into property transfer", r"\b(?:deceived|tricked|seduced|defrauded?)\s+(?:a\s+)?person\s+into\s+(?:giv(?:e|ing)|hand(?:ing)?\s+over|deliver(?:ing)?|transfer(?:ring)?|sell(?:ing)?)\s+(?:any\s+)?property\b"),
    ("led to property transfer", r"\b(?:led|induced|persuaded|caused|made|forced)\s+(?:him|her|them|a\s+person|person|someone)?\s*(?:to\s+)?(?:give|hand\s+over|deliver|transfer|sell)\s+(?:(?:him|her|them|a\s+person|someone)\s+)?(?:false\s+|any\s+)?property\b"),
    ("without consent", rf"\bwithout\s+(?:the\s+)?(?:{_ANYONES})?consent\b"),
    ("without permission", rf"\bwithout\s+(?:the\s+)?(?:{_ANYONES})?permission\b"),
    ("out of possession", rf"\bout\s+of\s+(?:{_ONES})?possession\b"),
    ("from possession", rf"\bfrom\s+(?:{_ONES})?possession\b"),
    ("victim property stolen", rf"\b(?:{_VICTIMS}\s+(?:[a-z]+\s+){{1,3}}(?:was|were|got)\s+stolen|got\s+{_VICTIMS}\s+(?:[a-z]+\s+){{1,4}}stolen)\b"),
    ("seriously injured", r"\bseriously\s+injur(?:e|ed|es|ing)\b"),
    ("serious injury", r"\bserious\s+injur(?:y|ies)\b"),
    ("grievous hurt", r"\bgrievous\s+hurt\b"),
    ("caused hurt", r"\b(?:voluntarily\s+)?caus(?:e|ed|es|ing)\s+(?:bodily\s+)?hurt\b"),
    ("caused injury", r"\b(?:caus(?:e|ed|es|ing)|inflict(?:ed|s|ing)?|seriously\s+injur(?:e|ed|es|ing))\s+(?:serious\s+|bodily\s+|grave\s+|grievous\s+)?injur(?:y|ies|e|ed|es|ing)\b"),
    ("physical injury", r"\b(?:physical|bodily)\s+injur(?:y|ies|e|ed|es|ing)\b"),
    ("physical harm", r"\b(?:caus(?:e|ed|es|ing)\s+)?(?:physical|bodily)\s+harm\b"),
    ("bodily pain", r"\bbodily\s+pain\b"),
)

# Cues of the offence date near a date, and of conduct that goes on.
OFFENCE_HINTS = ("offense", "offence", "crime", "act", "incident", "conduct", "committed", "happened", "took place")
CONTINUING = r"\b(continued|continuing|ongoing|from|between|until|through|spanning|completed after|started before)\b"
UNDECIDED = r"\b(continued|continuing|until|through|between|spanning)\b"
CUTOFF = "2024-07-01"

# First code points of the digit blocks that are read as ASCII digits.
DIGIT_BLOCKS = (0x0966, 0x0AE6, 0x0660, 0x06F0, 0x09E6, 0x0A66, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66)

# Acronyms as other scripts spell them.
ACRONYMS = (
    ("BNSS", ("बीएनएसएस", "बी एन एस एस", "બીએનએસએસ", "بی این ایس ایس")),
    ("CrPC", ("सीआरपीसी", "सी आर पी सी", "સીઆરપીસી", "سی آر پی سی")),
    ("IPC", ("आईपीसी", "आयपीसी", "आई पी सी", "आई.पी.सी.", "આઈપીસી", "આઈ પી સી", "آئی پی سی", "آئی-پی-سی")),
    ("BNS", ("बीएनएस", "बी एन एस", "બીએનએસ", "બી એન એસ", "بی این ایس")),
)
SCRIPT_BLOCKS = (("gujarati", r"[\x{0A80}-\x{0AFF}]"), ("arabic", r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]"), ("devanagari", r"[\x{0900}-\x{097F}]"), ("latin", "[A-Za-z]"))

# The terms that transcripts are corrected to.
LEXICON = (
    "Bharatiya Nyaya Sanhita", "Bharatiya Nagarik Suraksha Sanhita", "Indian Penal Code", "Code of Criminal Procedure", "criminal breach of trust", "dishonest intention", "movable property", "without consent", "grievous hurt",
    "culpable homicide", "wrongful restraint", "wrongful confinement", "criminal intimidation", "criminal conspiracy", "organized crime", "extortion", "misappropriation", "defamation", "kidnapping", "abduction",
)
# Entity vocabulary of the English profile and words shared by all profiles.
SECTION_WORDS = ("section", "sections", "sec", "धारा", "कलम", "કલમ", "દફા", "دفعہ", "دفعه")
LAW_CODES = ("IPC", "BNS", "BNSS", "CrPC")
MONEY_WORDS = ("rupees", "rupee", "rs", "inr", "रुपये", "रुपए", "रूपये", "रुपया", "रु", "रू", "રૂપિયા", "રૂપિયો", "રૂ", "روپے", "روپیہ", "روپیے")
LAW_NAMES = (("Indian Penal Code", "IPC"), ("Bharatiya Nyaya Sanhita", "BNS"), ("Code of Criminal Procedure", "CrPC"), ("भारतीय दंड संहिता", "IPC"), ("भारतीय न्याय संहिता", "BNS"), ("ભારતીય દંડ સંહિતા", "IPC"), ("ભારતીય ન્યાય સંહિતા", "BNS"), ("مجموعہ تعزیرات", "IPC"))
OFFENCES = (("theft", "theft"), ("cheating", "cheating"), ("robbery", "robbery"), ("dacoity", "dacoity"), ("murder", "murder"), ("extortion", "extortion"), ("kidnapping", "kidnapping"), ("defamation", "defamation"), ("forgery", "forgery"), ("criminal intimidation", "criminal intimidation"), ("चोरी", "theft"), ("ठगी", "cheating"), ("हत्या", "murder"), ("मारपीट", "hurt"), ("ચોરી", "theft"), ("છેતરપિંડી", "cheating"), ("چوری", "theft"), ("قتل", "murder"))
