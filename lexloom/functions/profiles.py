"""What five languages have of their own: function words, negations, endings, and the column functions that read them. Null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import words

# Function words, negations (kept apart, since they carry meaning), endings, and letters that a stem keeps at least.
STOP = {
    "en": words.ENGLISH_STOP,
    "hi": """अपना अपनी अपने आप इन इनका इस इसका इसकी इसके इसमें इसी इसे उन उनका उनकी उनके उनको उस उसके उसी उसे एक एवं और कई कर करता करते करना करने करें कहा का कि किया किस किसी किसे की कुछ कुल के को कोई कौन गया जब जहाँ जहां जा जिन जिस जिसे जैसा जैसे जो तक तब तरह तो था थी थे दो द्वारा
        ने पर पहले फिर बहुत बाद भी मगर में यदि यह यहाँ यहां यही या ये रहा रही रहे लिए लिये लेकिन वह वहाँ वहां वही वे सकता सकते सबसे सभी साथ से सो ही हुआ हुई हुए है हैं हो होता होती होते होना होने मैं मुझे मुझको मेरा मेरी मेरे हम हमारा हमारी हमारे तुम तुम्हारा आपका आपकी आपके कैसे क्या क्यों कब कहाँ""".split(),
    "mr": "आणि आहे आहेत होता होती होते मध्ये ने ला चा ची चे च्या ना हा ही हे तो ती ते या त्या एक पण की जे जर तर वर साठी सह मी आम्ही तुम्ही माझा माझी माझे माझ्या झाला झाली झाले केला केली केले त्याने तिने त्याचा त्याची त्याचे आता तेव्हा जेव्हा काही कोणी".split(),
    "gu": "અને છે હતો હતી હતું હતા માં થી ને નો ની નું ના એક આ તે એ પણ કે જે જો તો પર સાથે માટે થયું થયો થઈ થયા કર્યું કરી કરવા કરે હું અમે તમે મારો મારી મારું મારા તેના તેની તેનું તેણે ત્યારે જ્યારે હવે ફક્ત વધુ ખૂબ કોઈ કંઈ છું છીએ છો તેમ તેમાં આમાં".split(),
    "ur": "اور کا کی کے کو میں سے پر ہے ہیں تھا تھی تھے ہو ہوا ہوئی ہوئے نے کہ یہ وہ ان اس ایک بھی تو یا لیے لئے ساتھ کر کیا کرنے کرتا کرتے گیا گئی گئے رہا رہی رہے سکتا ہم میرا میری میرے آپ تم اپنا اپنی اپنے جو جب تک بعد پہلے کوئی کچھ بہت ہی ہوں تھیں ہوتا ہوتی ہوتے".split(),
}
NEGATIONS = {"en": words.ENGLISH_NEGATIONS, "hi": "नहीं न मत बिना".split(), "mr": "नाही न नको शिवाय".split(), "gu": "નથી ન નહીં વગર".split(), "ur": "نہیں نہ بغیر".split()}
ENDINGS = {
    "en": list(words.ENGLISH_SUFFIXES),
    "hi": "ाइयों ाइयाँ ियों ियाँ ाओं ाएँ ाएं ाना ाने ाता ाते ाती ाया ाई ाए ीय ें ों ीं ाँ ां ो े ी ा ि".split(),
    "mr": "ांमध्ये ांच्या ाच्या ांचा ांची ांचे ाचा ाची ाचे ांना ांनी ाला ाने ांत ात ा ी े".split(),
    "gu": "ોમાં ોને ોનો ોની ોનું ોથી ોના માં ને થી નો ની નું ના ો ી ું ે ા".split(),
    "ur": "یاں وں یں ات ان ی ے ا".split(),
}
KEPT = {"en": 3, "hi": 2, "mr": 2, "gu": 2, "ur": 2}
# Words that tell Marathi from Hindi.
MARATHI, HINDI = r"(?:आहे|आहेत|झाला|झाली|केला|केली|मध्ये|त्याने|नाही)", r"(?:है|हैं|हुआ|हुई|किया|में|उसने|नहीं)"
#: Scripts of one language each.
ALONE = {"gu": "0A80-0AFF", "bn": "0980-09FF", "ta": "0B80-0BFF", "te": "0C00-0C7F", "kn": "0C80-0CFF", "ml": "0D00-0D7F", "pa": "0A00-0A7F", "ur": "0600-06FF"}


def _by(language: Column, choose) -> Column:
    """One expression for each language; null for others."""
    out = F.when(language == "en", choose("en"))
    for code in ("hi", "mr", "gu", "ur"):
        out = out.when(language == code, choose(code))
    return out


def is_stop(word: Column, language: Column) -> Column:
    return _by(language, lambda code: F.lower(word).isin(*STOP[code]))


def is_negation(word: Column, language: Column) -> Column:
    return _by(language, lambda code: F.lower(word).isin(*NEGATIONS[code]))


def stem(word: Column, language: Column) -> Column:
    """A word without its longest ending that leaves enough letters; function words, negations and short words stay as they are."""

    def one(code: str) -> Column:
        own = F.lower(word) if code == "en" else word
        kept = F.when((F.length(word) <= KEPT[code] + 1) | F.lower(word).isin(*STOP[code], *NEGATIONS[code]), word)
        return kept.otherwise(F.regexp_replace(own, f"(?<=.{{{KEPT[code]}}})(?:{'|'.join(sorted(ENDINGS[code], key=len, reverse=True))})$", ""))

    return _by(language, one)


def guessed_language(text: Column) -> Column:
    """The language that a text's script and, for Devanagari, its words tell; null where they tell none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, block in ALONE.items():
        low, high = block.split("-")
        out = out.when(text.rlike(rf"[\x{{{low}}}-\x{{{high}}}]"), code)
    points = lambda *patterns: sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))
    mr, hi = points(MARATHI, "ळ", "ऱ"), points(HINDI, "ड़|ढ़")
    return out.when(text.rlike(r"[\x{0900}-\x{097F}]"), F.when(mr > hi, "mr").when(hi > mr, "hi"))
