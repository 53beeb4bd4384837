"""Word lists, rules and cases that results depend on.

Fixed values: these must equal published behaviour for equal results. Dictionaries of senses and
of child-friendly definitions are parameters (DataFrames) of the operators that use them.
"""

from __future__ import annotations

# Topics with their names and keywords, in their order.
TOPICS = {
    "matter": (
        "Properties of Matter & States of Matter",
        "matter states solid liquid gases gas volume mass shape space particles molecules density bucket bottle water mouth facing downwards everything around exists three empty fill",
    ),
    "optics": ("Light, Shadows & Reflections", "light shadow transparent translucent opaque materials pass reflection refraction ray beam source object glass wood water mirror straight path"),
    "biology": ("Living Organisms & Plants", "plants animals photosynthesis leaves stem roots oxygen carbon dioxide chlorophyll cell organism food sunlight water growth nutrition"),
}

# Subjects with display name, keywords and title patterns, in their order.
SUBJECTS = {
    "Science": (
        "Elementary & Middle School Science",
        "science matter solid liquid gas gases volume density mass evaporation condensation melting freezing experiment observation hypothesis conclusion property properties transparent opaque "
        "translucent energy force motion gravity friction magnet magnetic circuit light shadow reflection temperature thermometer heat boiling solution mixture dissolve",
        (r"properties\s+of\s+matter", r"states\s+of\s+matter", r"light\s+shadow", r"science\s+notes?", r"chapter\s*\d*\s*:?\s*science"),
    ),
    "Mathematics": (
        "Mathematics & Geometry",
        "math mathematics equation fraction numerator denominator variable algebra geometry triangle rectangle square circle radius diameter perimeter area volume angle hypotenuse pythagoras theorem "
        "sum difference product quotient ratio percentage decimal integer polynomial function graph axis slope derivative integral matrix vector probability statistics",
        (r"math(?:ematics)?\s+notes?", r"algebra", r"geometry", r"fraction", r"equation"),
    ),
    "Physics": (
        "Physics",
        "physics velocity acceleration force newton gravity mass momentum kinetic potential energy work power joule watt inertia friction vector scalar displacement speed wave frequency wavelength "
        "amplitude optics refraction diffraction current voltage resistance ohm ampere magnetic field",
        (r"physics", r"laws?\s+of\s+motion", r"work\s+and\s+energy", r"electricity"),
    ),
    "Chemistry": (
        "Chemistry",
        "chemistry atom atomic molecule molecular element compound reaction reactant product chemical acid base ph salt solution solute solvent concentration molarity valence electron proton neutron "
        "ion ionic covalent bond bonding periodic table oxidation reduction catalyst isotope",
        (r"chemistry", r"chemical\s+reactions?", r"acids?\s+and\s+bases?", r"atomic\s+structure"),
    ),
    "Biology": (
        "Biology & Life Sciences",
        "biology cell cellular photosynthesis chlorophyll plant animal organism ecosystem respiration tissue organ nucleus dna rna gene genetics enzyme membrane mitochondria leaf stem root blood heart "
        "circulatory digestive nervous species",
        (r"biology", r"life\s+processes", r"plants?\s+and\s+animals?", r"cell\s+structure"),
    ),
    "Geography": (
        "Geography & Earth Sciences",
        "geography latitude longitude equator hemisphere continent ocean climate weather erosion weathering atmosphere crust mantle core volcano earthquake glacier topography map river mountain plateau "
        "plain sediment soil tropic poles",
        (r"geography", r"earth\s+science", r"climate\s+and\s+weather", r"maps?\s+and\s+globes?"),
    ),
    "History": (
        "History & Social Studies",
        "history century empire emperor king queen dynasty revolution treaty war battle independence reign civilization constitution colony colonial movement charter monarchy republic ancient medieval",
        (r"history", r"social\s+studies", r"ancient\s+civilization", r"freedom\s+movement"),
    ),
    "Computer Science": (
        "Computer Science & Information Technology",
        "computer code coding algorithm programming python java variable function loop iteration array binary compiler network database memory cpu software hardware internet protocol",
        (r"computer\s+science", r"programming", r"data\s+structures?", r"python"),
    ),
    "English": (
        "English Language & Literature",
        "english grammar noun verb adjective adverb pronoun preposition conjunction interjection sentence paragraph essay prose poetry poem stanza rhyme metaphor simile alliteration synonym antonym "
        "punctuation comprehension summary character",
        (r"english", r"grammar", r"literature", r"reading\s+comprehension", r"poetry"),
    ),
}

# Common words of the scorer of recognisers.
MODEL_WORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up "
    "out if about who get which go me when make can like time no just him know take people into year your good some could them see other than then now look only come "
    "its over think also back after use two how our work first well way even new want because any these give day most us matter states solid liquid gas gases light "
    "shadow opaque transparent translucent energy force cell plant animal water earth sun moon star equation fraction number sum difference product part system body "
    "food"
).split()

# Common words of the scorer of image scales.
SCALE_WORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up "
    "out if about who get which go me when make can like time no just him know take people into year your good some could them see other than then now look only come "
    "its over think also back after use two how our work first well way even new want because any these give day most us matter states solid liquid gas gases light "
    "shadow opaque transparent translucent energy force cell plant animal water earth sun moon star equation fraction number sum difference product part system body "
    "food air pressure acid base metal heat temperature color shape volume mass density line point angle triangle circle square"
).split()

# Common words of the language check.
LANGUAGE_WORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up "
    "out if about who get which go me when make can like time no just him know take people into year your good some could them see other than then now look only come "
    "its over think also back after use two how our work first well way even new want because any these give day most us rainbow sky green blue yellow orange violet "
    "indigo red clouds peeping sun bicycle rode road book read school answer question questions yes no ans implementation usability"
).split()

# Function words of the grammar router.
FUNCTION_WORDS = (
    "a an the is are am was were be been being has have had do does did and but or so if in on at to for with by from of up out it its this that these those they them their we us our"
).split()

# Fixed values: (pattern, replacement) of handwriting confusions, matched whatever the case.
CONFUSIONS = (
    (r"\bskv\b", "sky"),
    (r"\byellov\b", "yellow"),
    (r"\bvellov\b", "yellow"),
    (r"\bpeepina\b", "peeping"),
    (r"\bfeefing\b", "peeping"),
    (r"\bareen\b", "green"),
    (r"\boraaqe\b", "orange"),
    (r"\boranae\b", "orange"),
    (r"\bviovet\b", "violet"),
    (r"\bindiao\b", "indigo"),
    (r"\bindiqo\b", "indigo"),
    (r"\bfroin\b", "from"),
    (r"\boji\b", "on"),
    (r"\blhale\b", "have"),
)

# Fixed values: (pattern, replacement, topic, confidence) of sentence reconstructions; the first match only.
RECONSTRUCTIONS = (
    (r"\bUs\s+is\s+made\s+of\s+matte[a-zA-Z]*\s*[a-zA-Z]*\s*exists\s+in\s+3\s+states\b", "Everything around us is made of matter. Matter exists in three states: solid, liquid and gases.", "matter", 0.96),
    (r"\bEverything\s+around\s+us\s+is\s+made\s+of\s+matte[a-zA-Z]*\.?\s*(?:Matter|Mattr)?\s*(?:exists|exist)?\s*in\s*3\s*states\b", "Everything around us is made of matter. Matter exists in three states: solid, liquid and gases.", "matter", 0.96),
    (r"\bEil\s+Jueket\s+with\s+water\s+Take\s+ang?\s+tempt\s+braille\b", "Fill a bucket with water. Take an empty bottle with its mouth facing downwards.", "matter", 0.95),
    (r"\bFill\s+a?\s*bucket\s+with\s+water\s*\.?\s*Take\s+an?\s+empty?\s*bottle\b(?:\s+with|\s+its|\s+[a-z]+)*", "Fill a bucket with water. Take an empty bottle with its mouth facing downwards.", "matter", 0.95),
    (r"\bMatrials\s+which\s+light\s+does\s+pass\s+atall\s+thccaldbd\s+is\s+Opaque\b", "Materials through which light does not pass at all are called Opaque.", "optics", 0.96),
    (r"\bMaterials?\s+(?:through\s+)?which\s+light\s+does\s+pass\s+at\s*all\s+are\s+called\s+Opaque\b", "Materials through which light does not pass at all are called Opaque.", "optics", 0.95),
)

# Fixed values: (pattern, replacement) of vocabulary by topic.
TOPIC_WORDS = {
    "matter": ((r"\bmattr\b", "matter"), (r"\bbuoket\b", "bucket"), (r"\bdownward\b", "downwards")),
    "optics": ((r"\bopaqe\b", "Opaque"), (r"\btranslucnt\b", "Translucent"), (r"\btransparnt\b", "Transparent")),
}

# Fixed values: (tag, pattern) of line structure, first match wins.
STRUCTURES = (
    ("Heading", r"^(?:chapter|unit|section|lesson|\d+[\.\)])\s*.*|^(?:properties|states|laws|principles|types)\s+of\s+.*"),
    ("Definition", r"^(?:definition|defined\s+as|is\s+called|are\s+called|refers\s+to|means)\b|:.*(?:defined|called)"),
    ("Activity", r"^(?:activity|task|exercise|practical)\s*\d*:?"),
    ("Experiment", r"^(?:experiment|aim|apparatus|procedure|method)\s*\d*:?"),
    ("Observation", r"^(?:observation|result|inference|observed)\s*\d*:?"),
    ("Procedure", r"^(?:fill|take|mix|heat|add|place|measure|connect|press|hold|drop|cut)\s+(?:a|an|the|some|\d+)\b"),
    ("Conclusion", r"^(?:conclusion|hence|therefore|thus|summary)\s*:?"),
    ("QA", r"^(?:q\d*|question|ans\d*|answer)\s*[:\.]"),
    ("Bullet", r"^(?:[\-\*\•\d+\.\)])\s+"),
)

# Fixed values: (pattern, replacement) of heading spellings.
HEADINGS = (
    (r"\bpropeties\s+of\s+matier\b", "Properties of Matter"),
    (r"\bpropertis\s+of\s+matter\b", "Properties of Matter"),
    (r"\bactvity\b", "Activity"),
    (r"\bexperment\b", "Experiment"),
    (r"\bobservaton\b", "Observation"),
    (r"\bprocedur\b", "Procedure"),
    (r"\bconcluson\b", "Conclusion"),
    (r"\bdefination\b", "Definition"),
    (r"\bdefinintion\b", "Definition"),
)

# Fixed values: (pattern, replacement) of the visual check.
VISUAL = ((r"\bpropeties\b", "properties"), (r"\bmatier\b", "matter"), (r"\bbuoket\b", "bucket"), (r"\bopaqe\b", "opaque"), (r"\btranslucnt\b", "translucent"), (r"\btransparnt\b", "transparent"))

# Fixed values: (pattern, replacement, category, confidence) of contextual rules, over the whole text.
CONTEXT = (
    (r"\b(boy|girl|man|woman|child|student|he|she|they|I|we)\s+road\b(?=\s+(?:a|the|his|her|my|their)?\s*(?:[a-z]+?\s+)?(?:bicycle|bike|horse|car|bus|vehicle|scooter|wagon))", "$1 rode", "Contextual Substitution", 0.96),
    (r"\bthe\s+rode\b(?=\s+(?:was|is|to|led|smooth|paved|busy))", "the road", "Contextual Substitution", 0.95),
    (r"\b(he|she|they|I|we|student|child|girl|boy)\s+red\b(?=\s+(?:a|the|his|her|my|their)?\s*(?:[a-z]+?\s+)?(?:book|story|novel|text|page|paper|chapter|lesson))", "$1 read", "Contextual Substitution", 0.96),
    (r"\b(have|has|had)\s+red\b", "$1 read", "Contextual Substitution", 0.95),
    (r"\b(can|could|will|would|to|shall|should|may|might|must|I|you|we|they|he|she)\s+sea\b(?=\s+(?:a|the|his|her|my|their|any)?\s*(?:[a-z]+?\s+)?(?:rainbow|sky|sun|stars|birds|colors|picture|page|view))", "$1 see", "Contextual Substitution", 0.96),
    (r"\b(in|on|into|across|under)\s+the\s+see\b", "$1 the sea", "Contextual Substitution", 0.95),
    (r"\btheir\s+(are|is|was|were|will\s+be|have\s+been)\b", "there $1", "Contextual Substitution", 0.96),
    (r"\bthere\s+(book|books|house|father|mother|school|crayon|crayons|favorite|work|answer|answers)\b", "their $1", "Contextual Substitution", 0.95),
    (r"\bthe\s+son\b(?=\s+(?:is|was|shining|rises|sets|bright|in the sky|shines))", "the sun", "Contextual Substitution", 0.95),
    (r"\b(his|her|my|their|our)\s+sun\b(?=\s+(?:went|plays|is a|studies|like|likes))", "$1 son", "Contextual Substitution", 0.94),
    (r"\b(I|he|she|we|they|student)\s+cat\b(?=\s+(?:the|a|his|her)?\s*(?:[a-z]+?\s+)?(?:paper|cloth|string|fruit|vegetable|line|shape)\s+with)", "$1 cut", "Contextual Substitution", 0.95),
    (r"\b(letter|gift|message|calling|coming|received|brought)\s+form\b(?=\s+(?:the|a|his|her|my|school|teacher))", "$1 from", "Contextual Substitution", 0.94),
    (r"\b(more|larger|bigger|smaller|greater|better|faster|slower|taller|shorter)\s+thin\b", "$1 than", "Contextual Substitution", 0.95),
    (r"\bif\s+([^\n,]+),\s*than\b", "if $1, then", "Grammar Correction", 0.94),
    (r"\b(press|apply|foot\s+on)\s+the\s+break\b", "$1 the brake", "Contextual Substitution", 0.94),
)

# Fixed values: (pattern, replacement, category, confidence) of line rules. "@ans" and "@capital" are computed.
LINE_RULES = (
    (r"\b(i)\b", "I", "Capitalization", 0.96),
    (r"\b(i'm)\b", "I'm", "Capitalization", 0.96),
    (r"\b(i've)\b", "I've", "Capitalization", 0.96),
    (r"\b(i'll)\b", "I'll", "Capitalization", 0.96),
    (r"\b(i'd)\b", "I'd", "Capitalization", 0.96),
    (r"\bans:\s*([a-z])", "@ans", "Capitalization", 0.90),
    (r"^(which|where|how|have|what|do|name)\b", "@capital", "Capitalization", 0.88),
    (r"(\w+)\s+\?", "$1?", "Punctuation Improvement", 0.95),
    (r"(\w+)\s+:", "$1:", "Punctuation Improvement", 0.95),
    (r"\bAns;\s*", "Ans: ", "Punctuation Improvement", 0.94),
    (r"\bAns\.\s*", "Ans: ", "Punctuation Improvement", 0.94),
    (r"\b(Ans:\s*)(yes|no)\b", "$1Yes,", "Punctuation Improvement", 0.94),
    (r"\bthere is (\w+) (colour|colors|things|items)\b", "there are $1 $2", "Grammar Correction", 0.90),
    (r"\bmake sentence of own\b", "make sentence of your own", "Grammar Correction", 0.92),
    (r"\banswer the following question\b", "answer the following questions", "Grammar Correction", 0.88),
    (r"\bI sees\b", "I see", "Grammar Correction", 0.92),
    (r"\bwe sees\b", "we see", "Grammar Correction", 0.92),
    (r"\bthey is\b", "they are", "Grammar Correction", 0.92),
    (r"\bhave you see\b", "have you seen", "Grammar Correction", 0.94),
    (r"\bI has seen\b", "I have seen", "Grammar Correction", 0.94),
    (r"\bof (?:the )?platform\b", "of the platform", "Missing Word", 0.88),
    (r"\bin (?:the )?sky\b", "in the sky", "Missing Word", 0.92),
    (r"\bsee (?:the )?rainbow\b", "see the rainbow", "Missing Word", 0.92),
    (r"\bcolours in (?:the )?rainbow\b", "colours in the rainbow", "Missing Word", 0.92),
    (r"\bfroin\b", "from", "Character Confusion", 0.94),
    (r"\boji\b", "on", "Character Confusion", 0.94),
    (r"\bskv\b", "sky", "Character Confusion", 0.94),
    (r"\byellov\b", "yellow", "Character Confusion", 0.94),
    (r"\bvellov\b", "yellow", "Character Confusion", 0.94),
    (r"\bpeepina\b", "peeping", "Character Confusion", 0.94),
    (r"\bfeefing\b", "peeping", "Character Confusion", 0.94),
    (r"\bareen\b", "green", "Character Confusion", 0.94),
    (r"\boraaqe\b", "orange", "Character Confusion", 0.94),
    (r"\boranae\b", "orange", "Character Confusion", 0.94),
    (r"\bviovet\b", "violet", "Character Confusion", 0.94),
    (r"\bindiao\b", "indigo", "Character Confusion", 0.94),
    (r"\bindiqo\b", "indigo", "Character Confusion", 0.94),
    (r"\bimplomentation\b", "implementation", "Spelling Correction", 0.92),
    (r"\busebility\b", "usability", "Spelling Correction", 0.92),
    (r"\bKowid\b", "COVID", "Spelling Correction", 0.90),
    (r"\bmetrix\b", "matrix", "Spelling Correction", 0.92),
)

# Fixed values: (pattern, replacement) of contractions, whatever the case.
CONTRACTIONS = (
    (r"\b(can)not\b", "cannot"),
    (r"\b(do)nt\b", "don't"),
    (r"\b(does)nt\b", "doesn't"),
    (r"\b(did)nt\b", "didn't"),
    (r"\b(is)nt\b", "isn't"),
    (r"\b(are)nt\b", "aren't"),
    (r"\b(was)nt\b", "wasn't"),
    (r"\b(were)nt\b", "weren't"),
    (r"\b(has)nt\b", "hasn't"),
    (r"\b(have)nt\b", "haven't"),
    (r"\b(had)nt\b", "hadn't"),
    (r"\b(would)nt\b", "wouldn't"),
    (r"\b(could)nt\b", "couldn't"),
    (r"\b(should)nt\b", "shouldn't"),
    (r"\b(it)s\b(?=\s+(?:a|an|the|very|so|not|good|bad|great|important|easy|hard)\b)", "it's"),
    (r"\b(im)\b", "I'm"),
    (r"\b(ive)\b", "I've"),
    (r"\b(ill)\b(?=\s+(?:be|go|do|have|see|get|take|make)\b)", "I'll"),
    (r"\b(id)\b(?=\s+(?:like|love|rather|prefer|have|be)\b)", "I'd"),
    (r"\b(they)re\b", "they're"),
    (r"\b(we)re\b(?=\s+(?:going|doing|having|seeing|making|getting|planning)\b)", "we're"),
    (r"\b(you)re\b", "you're"),
    (r"\b(thats)\b", "that's"),
    (r"\b(whats)\b", "what's"),
    (r"\b(theres)\b", "there's"),
)
POSSESSIVE = r"\b([a-zA-Z]{3,})s\b(?=\s+(?:book|pencil|bag|teacher|desk|work|homework|answer|story|idea|father|mother|family)\b)"
QUESTION = r"(?:^|[.?!]\s+)(what|where|when|why|who|how|which|can you|could you|would you|do you|have you)\b[^.?!:\n]+(?=[.?!]|\s*$)"
OPENER = r"^(However|Therefore|Moreover|In addition|First|Second|Finally|Suddenly|On the other hand|In conclusion)\s+([a-zA-Z])"
BOUNDARY = r"([a-z]{2,})\s+([A-Z][a-z]{2,}\s+(?:is|are|was|were|has|have|had|will|should|could|would)\b)"

# Card style of each category; others are grammar_explanation.
CARD_STYLES = {
    "Spelling Mistake": "spelling",
    "Spelling Correction": "spelling",
    "Vocabulary Improvement": "vocabulary",
    "Contextual Word Correction": "vocabulary",
    "Contextual Substitution": "vocabulary",
    "Grammar Correction": "grammar_explanation",
    "Subject-Verb Agreement": "grammar_explanation",
    "Verb Tense": "grammar_explanation",
    "Article Usage": "grammar_explanation",
    "Preposition Usage": "grammar_explanation",
    "Punctuation Correction": "punctuation_practice",
    "Punctuation Improvement": "punctuation_practice",
    "Missing Word": "fill_in_blank",
    "Capitalization": "capitalization_rule",
    "Capitalization Correction": "capitalization_rule",
    "Sentence Restructuring": "sentence_reconstruction",
    "Style Suggestion": "sentence_reconstruction",
    "Stylistic Improvement": "sentence_reconstruction",
    "OCR Confidence Recovery": "spelling",
    "Character Confusion": "spelling",
}

# Default weights of a user's character confusions.
CHAR_CONFUSIONS = {
    "v": {"y": 0.35, "u": 0.20},
    "y": {"v": 0.35, "g": 0.25},
    "g": {"a": 0.30, "q": 0.20},
    "a": {"g": 0.30, "o": 0.20},
    "cl": {"d": 0.40},
    "rn": {"m": 0.40},
    "1": {"l": 0.35, "I": 0.30},
    "l": {"1": 0.35, "I": 0.25},
    "5": {"S": 0.35, "s": 0.25},
    "0": {"O": 0.35, "o": 0.30},
}

# File extensions that can be read.
EXTENSIONS = (".png", ".jpg", ".jpeg", ".pdf", ".bmp", ".tiff", ".tif", ".webp")
