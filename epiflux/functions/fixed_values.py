"""Word lists, lookup tables and patterns that results depend on.

Each block is one plain list, table or pattern.
"""

from __future__ import annotations


# Common English function words.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma
mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

# Words of the short-message domain that carry no topic.
DOMAIN_STOP_WORDS = """
rt amp get got hey hmm hoo hop iep let ooo par pdt pln pst wha yep yer aest didn nzdt via dont one com
make say would im should could really way ya also while know free always put week went wasn was used
ugh try kind http much next app using &amp w/ ued btw imo may says said see keep please still look
possible taking already must want every yet since told likely another aint apparent like think due
take says getting tell even ever actually absolutely about any am need go going retweet virus covid
convid coronavid corona coronavirus covidー prep ready
""".split()

STOP_WORDS = sorted(set(ENGLISH_STOP_WORDS) | set(DOMAIN_STOP_WORDS))

# Term normalisation, applied in this order.
TERM_RULES = [
    ("corona", ""),
    ("prepare|preparation|prepared|preparedness|prepd", "prep"),
    ("testing|tests|tested", "test"),
    ("cases", "case"),
    ("realdonaldtrump", "trump"),
    ("hospitals", "hospital"),
    ("^cent$|centers|central|centre|centres", "center"),
]

# Fixed value: hashtags that only restate the subject of the collection.
SUBJECT_HASHTAGS = "covid|corona$|cor[a-z]+virus|coronaoutbreak|coronvirus|2019ncov|update"

# Phrases tracked by the two live collections.
TRACKED_PREPAREDNESS = [
    "virus prep",
    "covid prep",
    "coronavirus prep",
    "virus prepare",
    "covid prepare",
    "coronavirus prepare",
    "virus preparation",
    "covid preparation",
    "coronavirus preparation",
    "virus ready",
    "covid ready",
    "coronavirus ready",
    "virus readiness",
    "covid readiness",
    "coronavirus readiness",
]
TRACKED_DISEASE = ["virus", "covid", "coronavirus"]

# Line-list recodes.
OUTCOME_GROUPS = {
    "died": "died",
    "Dead": "died",
    "Death": "died",
    "Deceased": "died",
    "discharged": "recovered",
    "stable": "recovered",
    "Alive": "recovered",
}
MARKET_EXPOSURE = {
    "yes": 1,
    "no": 0,
    "yes, retailer in the seafood wholesale market": 1,
    "working in another market in Wuhan": 1,
    "18.01.2020 - 23.01.2020": 1,
    "18.01.2020 - 23.01.2019": 1,
}
SEX_CODES = {"female": 0, "male": 1}
REGION_TO_COUNTRY = {
    "Jammu and Kashmir": "India",
    "Jharkhand": "India",
    "Delhi": "India",
    "Puducherry": "India",
    "Rajasthan": "India",
    "Uttar Pradesh": "India",
    "Tamil Nadu": "India",
    "Andhra Pradesh": "India",
    "Maharashtra": "India",
    "Telangana": "India",
    "West Bengal": "India",
    "Uttarakhand": "India",
    "Ladakh": "India",
    "Himachal Pradesh": "India",
    "Odisha": "India",
    "Kerala": "India",
}

# Rank of a gazetteer feature code (1 = most important).
FEATURE_HIERARCHY = {
    "PCL": 1,
    "ADM1": 2,
    "PPLA": 2,
    "ADM2": 3,
    "PPLA2": 3,
    "PPLA3": 5,
    "PPLA4": 6,
    "PPLC": 4,
    "PPLG": 5,
    "PPL": 9,
    "PPLX": 10,
}

# Labels of the two origins of a place mapping.
SOURCE_GAZETTEER = "geonames_gazetter"
SOURCE_GEOCODER = "geocoder_mapquest_api"

# Country spellings that need a hand-set code.
COUNTRY_OVERRIDES = {
    "uk": "GB",
    "brasil": "BR",
    "usa": "US",
    "united states of america": "US",
    "estados unidos": "US",
    "republic of paraguay": "PY",
    "españa": "ES",
    "türkiye": "TR",
    "deutschland": "DE",
    "república dominicana": "DO",
    "republica dominicana": "DO",
    "méxico": "MX",
    "belgië": "BE",
    "belgique": "BE",
    "netherland": "NL",
    "the netherlands": "NL",
    "österreich": "AT",
    "kingdom of saudi arabia": "SA",
    "côte d'ivoire": "CI",
    "republic of korea": "KR",
    "sverige": "SE",
    "indonesiaraya": "ID",
    "phillipines": "PH",
}

# Names of US states and territories by abbreviation.
US_STATES = {
    "AL": "Alabama",
    "AK": "Alaska",
    "AS": "American Samoa",
    "AZ": "Arizona",
    "AR": "Arkansas",
    "CA": "California",
    "CO": "Colorado",
    "CT": "Connecticut",
    "DE": "Delaware",
    "DC": "District of Columbia",
    "FL": "Florida",
    "GA": "Georgia",
    "GU": "Guam",
    "HI": "Hawaii",
    "ID": "Idaho",
    "IL": "Illinois",
    "IN": "Indiana",
    "IA": "Iowa",
    "KS": "Kansas",
    "KY": "Kentucky",
    "LA": "Louisiana",
    "ME": "Maine",
    "MD": "Maryland",
    "MA": "Massachusetts",
    "MI": "Michigan",
    "MN": "Minnesota",
    "MS": "Mississippi",
    "MO": "Missouri",
    "MT": "Montana",
    "NE": "Nebraska",
    "NV": "Nevada",
    "NH": "New Hampshire",
    "NJ": "New Jersey",
    "NM": "New Mexico",
    "NY": "New York",
    "NC": "North Carolina",
    "ND": "North Dakota",
    "MP": "Northern Mariana Islands",
    "OH": "Ohio",
    "OK": "Oklahoma",
    "OR": "Oregon",
    "PA": "Pennsylvania",
    "PR": "Puerto Rico",
    "RI": "Rhode Island",
    "SC": "South Carolina",
    "SD": "South Dakota",
    "TN": "Tennessee",
    "TX": "Texas",
    "UT": "Utah",
    "VT": "Vermont",
    "VI": "Virgin Islands",
    "VA": "Virginia",
    "WA": "Washington",
    "WV": "West Virginia",
    "WI": "Wisconsin",
    "WY": "Wyoming",
}

# Patterns of location texts that name no place.
PLACE_BLACKLIST = (
    r"^-{2,}$|-*[0-9|\.]+[,|-]+[0-9|\.]+$|^::[0-9]+|in a|world|planet|universe|global|instagram|various|"
    r"earth|internet|retweets|website|somewhere|border|home|^[0-9.]+$|^ÜT:|🌎|🌍|🌏|☁️|🌙|🏡|✈|➡|🏳️|⭕|🌐|👽|"
    r"heaven|^www.|.com$|^http[s]*:/[/w]+|unknown|reality|¯\_(ツ)_/¯"
)
GEOCODER_BLACKLIST = r"^-{2,}$|^\+[0-9]{2,}$|allthespentfuelpoolsarecracked|一带一路"

# Location texts that are not places.
EXCLUDED_PLACES = [
    "", " ", "none", "\n", "\\n", "europe", "planet earth",
    "everywhere", "nowhere", "somewhere", "anywhere", "elsewhere", "knowhere",
    "partout", "nearby", "remote", "dystopia", "utopia", "matrix", "nomadic",
    "anywhere but here", "social distancing", "around", "mordor", "gallifrey",
    "here and there", "here & there", "here & now", "neither here nor there",
    "here, there and everywhere", "here", "there", "here.",
    "all over", "all over the place", "in the mountains", "the swamp",
    "in my head", "in your head", "in your heart", "in my heart", "in my mind", "in your mind",
    "the future", "the past", "history", "五大訴求 缺一不可", "dreamland", "chernobyl",
    "right here, right now", "inside", "outside", "bed", "some place",
    "climbing out of an oubliette", "c-137", "no", "yes", "maybe",
    "gotham", "gotham city", "gaia", "i sây", "mysoul", "dm04", "mother earth",
    "loading...", "visit our dedicated website @", "nationwide",
    "narnia", "basement", "neverland", "reality", "oz", "whoville", "hogwarts",
    "closet", "east coast!", "in the 6", "idk", "valyria", "classified",
    "winterfell", "wonderland", "westeros", "king's landing", "king landing", "kings landing",
    "in transit", "in limbo", "purgatory", "word", "milky way", "dreamville",
    "behind you", "i'm right here", "in rubber forever", "thinkstan",
    "hell", "heaven", "international", "internacional", "愛知県一宮市",
    "space", "universe", "multiverse", "the multiverse", "🌈", "pangea", "📍",
    "pluto", "mars", "mercury", "venus", "jupiter", "uranus", "saturn", "neptune",
    "worldwide", "global", "world", "world wide", "cyberspace",
    "princess park", "wakanda", "prison", "gryffindor", "variable",
    "planeta tierra", "the upside down", "airstrip one", "sant esteve de les roures",
    "doctor gonzalez", "rj", "rva", "nrw", "sp", "jvm", "phl", "e", "x", "ici", "rdc", "a", "u", "upd",
    "lost", "omnipresent", "ask why?", "#a2znews_org", "azania", "nunya", "murrayland",
    "he/she", "she/her", "she/her.", "they/them", "she/they", "he/they", "he/him", "ela/dela",
    "♡", "❤", "?", "???", "🪐", "shhhh", "facebook: baenegocios", "progressiveland",
    "internet", "jdsupra.com", "online", "twitter", "linkedin", "linkedin:",
    "iphone: 0.000000,0.000000", "facebook", "google", "youtube", "telegram",
    "sun", "moon", "star", "galaxy", "tinyurl", "blockchain",
    "zion", "paradise", "eden", "the void", "shangri-la", "in the land of nod",
    "the world", "rock planet", "around the world", "地球", "世界中", "世界",
    ".", "..", "...", "....", "home", "127.0.0.1", "wherever threads are written..",
    "world wide web", "www", "/dev/null", "-", "word wide", "undisclosed",
    "eu", "latinoamérica", "latam", "latin america", "south america", "latinoam√©rica unida", "latinoamerica",
    "🇪🇺", "🇫🇷 / 🇩🇪", "europe", "european union 🇪🇺", "se asia", "#africa #mena",
    "usa | uk | asia | australia", "far east", "#per√∫ / europa / #asia / latam", "am√©rica latina",
    "rome *** world *** 🇨🇦🏂⚡", "tabarnia", "afrique",
    "#genève #geneva 🇨🇭 or #japan", "madrid & seoul", "chetoslovaquia",
    "asia", "asia | australia - pacific", "antartica", "africa", "africa.",
    "uk, usa, jamaica and nigeria", "w.h.o.", "himalaya", "isolation",
    "rt's are fyi purposes only", "wealth building newsletter", "kekistan",
    "moderador(@)elconfidencial.com", "witness protection", "believeland", "tatooine",
    "primarily over at gab for now: https://gab.ai/overthemoonbat", "depression",
    "*rts are not endorsements*", "en todas partes", "*", "🌴", "überall.", "benelux",
    "retweets/likes does not equal", "𝐇𝐞𝐚𝐫𝐭 𝐨𝐟 𝐭𝐡𝐞 𝐑𝐞𝐛𝐞𝐥𝐥𝐢𝐨𝐧", "¯\\_(ツ)_/¯",
    "simulation", "grounded", "happyville", "sadness", "euphoria", "$$$", "allthespentfuelpoolsarecracked",
    "s,dáyes. unceded tsawout, tsawwassen, stz'uminus, penelakut lands (bc, canada) | cayuse, umatilla, walla walla, nimíipuu lands (oregon)",
]

# Location texts rewritten to a name the gazetteer knows.
PLACE_REMAP = {
    "america": "us",
    "'merica": "us",
    "north america": "us",
    "heartland,usa": "us",
    "trumpland": "us",
    "#dv #csa  #daniel_morgan": "us",
    "end citizens united": "us",
    "text resist to 50409": "us",
    "from sea to shining sea": "us",
    "usa today hq, mclean, va.": "us",
    "dc constitutional conservative": "us",
    "#theresistance #democracy #truth   #foster #adopt  no pet left behind 🐾": "us",
    "rick mccann founder-police chief/ff-emt/chaplain/author": "us",
    "in between disney cruises": "us",
    "ny | bos | sf | dc": "us",
    "etats-unis": "us",
    "🗽": "us",
    "🕊 spirit of america 🇺🇸": "us",
    "usa🇺🇸 tweets=personal views": "us",
    "u.s.a": "us",
    "u.s.a.": "us",
    "us of a": "us",
    "u s a": "us",
    "northeast usa": "us",
    "midwest, usa": "us",
    "midwest": "us",
    "land of the free": "us",
    "the south": "us",
    "south": "us",
    "mid-south": "us",
    "usa 🇺🇸": "us",
    "america 🇺🇸": "us",
    "#impeachtrump": "us",
    "somewhere, usa": "us",
    "mn lakes to tn mountains": "us",
    "s a v a n n a h": "savannah ga",
    "atl": "atlanta ga",
    "deep in the heart of texas": "texas",
    "htx": "houston tx",
    "atx": "austin tx",
    "satx": "san antonio tx",
    "kc": "kansas city",
    "kcmo": "kansas city, mo",
    "√α. в૯α૮ђ, √¡૨g¡ท¡α": "virgina beach, va",
    "va beach, virginia": "virgina beach, va",
    "nyc↔#longisland-atlantic~~": "new york, us",
    "ny/nj": "new york, us",
    "nj/ny": "new york, us",
    "la": "los angeles, us",
    "socal": "los angeles, us",
    "so cal": "los angeles, us",
    "southern california": "los angeles, us",
    "bay area, ca": "san francisco, us",
    "bay area": "san francisco, us",
    "the bay": "san francisco, us",
    "norcal": "san francisco, us",
    "northern california": "san francisco, us",
    "east bay, ca": "san francisco, us",
    "sf bay area": "san francisco, us",
    "san francisco bay area": "san francisco, us",
    "sf": "san francisco, us",
    "silicon valley": "san jose, us ",
    "california usa 🇺🇸": "california, us",
    "ca": "california, us",
    "left coast": "california, us",
    "east coast": "ny, us",
    "upstate ny": "ny state, us",
    "chicagoland": "chicago, us",
    "greater portland, oregon, usa": "portland, OR",
    "pacific northwest": "wa, us",
    "pnw": "wa, us",
    "washington state": "wa, us",
    "olympia wa": "olympia, us",
    "seatttle": "seattle, us",
    "dmv (d.c., maryland, virginia)": "washington dc, us",
    "dmv": "washington dc, us",
    "d(m)v": "washington dc, us",
    "city of brotherly love": "philadelphia, us",
    "somewhere out there in wi": "wisconsin, us",
    "lost in the minnesota north woods": "minnesota, us",
    "nola": "new orleans, us",
    "central pennsylvania": "pennsylvania, us",
    "sur de la florida": "miami, us",
    "atlanta, georgia": "atlanta, us",
    "puerto rico, usa": "puerto rico, us",
    "zúrich, suiza🇨🇭": "zurich, switzerland",
    "ελλάς": "greece",
    "world, le monde": "france",
    "qq. part entre le nord de la france-tokyo-shanghai": "france",
    "wurundjeri land": "australia",
    "suomi": "finland",
    "lima - perú": "lima, peru",
    "bs as.": "buenos aires, argentina",
    "bs as": "buenos aires, argentina",
    "cdnx / guadalajara / monterrey": "mexico",
    "distrito federal, méxico": "mexico city, mexico",
    "cuauht√©moc, distrito federal": "mexico city, mexico",
    "cdmx": "mexico city, mexico",
    "d.f.": "mexico city, mexico",
    "df": "mexico city, mexico",
    "méxico df": "mexico city, mexico",
    "méxico d.f.": "mexico city, mexico",
    "mexico df": "mexico city, mexico",
    "mexico d.f.": "mexico city, mexico",
    "caracas venuzuela": "caracas, venezuela",
    "caracas-venezuela": "caracas, venezuela",
    "caracas - venezuela": "caracas, venezuela",
    "caracas, distrito capital": "caracas, venuzuela",
    "bogotá-colombia": "bogotá, colombia",
    "bogotá d.c.": "bogotá, colombia",
    "guayaquil-ecuador": "guayaquil, ecuador",
    "rio grande do sul brazil": "rio grande do sul, brazil",
    "southern africa": "south africa",
    "frankfurt on the main, germany": "frankfurt, germany",
    "united kingdom 🇬🇧": "uk",
    "uk": "united kingdom",
    "americas | united kingdom": "united kingdom",
    "west midlands": "england",
    "south west, england": "england",
    "west midlands, england": "england",
    "east midlands, england": "england",
    "east, england": "england",
    "north east, england": "england",
    "scot": "scotland, united kingdom",
    "london uk": "london, uk",
    "ldn": "london, uk",
    "city of london": "london, uk",
    "москва, россия": "moscow, russia",
    "al shuwaikh, kuwait tel +965 22271800": "kuwait",
    "🅔🅤🅡🅞🅟🅔 - 🅢🅟🅐🅘🅝": "spain",
    "𝑬𝒖𝒔𝒌𝒂𝒅𝒊": "basque country, spain",
    "barcelona, catalunya": "barcelona, spain",
    "barcelona, cataluña": "barcelona, spain",
    "barcelona, catalana": "barcelona, spain",
    "barcelona, catalonia": "barcelona, spain",
    "república de catalunya": "catalonia, spain",
    "rep√∫blica de catalunya": "catalonia, spain",
    "rep√∫blica catalana": "catalonia, spain",
    "madrid-españa": "madrid, spain",
    "comunidad de madrid, españa": "madrid, spain",
    "mallorca": "mallorca, spain",
    "kashmir": "kashmir, india",
    "south asia": "india",
    "india🇮🇳": "india",
    "ncr": "india",
    "bengaluru south, india": "bengaluru, india",
    "bengaluru india": "bengaluru, india",
    "tokyo-to, japan": "tokyo, japan",
    "東京": "tokyo, japan",
    "日本 東京": "tokyo, japan",
    "中华人民共和国": "china",
    "北京, 中华人民共和国": "beijing, china",
    "上海, 中华人民共和国": "shanghai, china",
    "Ελλάς": "greece",
    "+233": "ghana",
    "+234": "nigeria",
    "+60": "malaysia",
    "+62": "indonesia",
    "+63": "phillipines",
    "nkri": "indonesia",
    "jakarta selatan, dki jakarta": "jarkarta, idonesia",
    "jakarta capital region": "jarkarta, idonesia",
    "muar • cyberjaya • kuantan": "malaysia",
    "kuala lumpur city": "kuala lumpur, malaysia",
    "münchen, bayern": "munich, germany",
    "#perÚ / europa / #asia / latam": "peru",
    "lagos nigeria": "lagos, nigeria",
    "federal capital territory, nig": "abuja, nigeria",
    "guadalajara, jalisco": "guadalajara, jalisco, mexico",
    "south east, england": "england",
    "mnl": "manila, philippines",
    "republic of the philippines": "philippines",
    "vancouver, bc": "vancouver, canada",
    "canada 🇨🇦": "canada",
    "🇨🇦https://www.healthangel999.com/  great leader =great doctor of a nation! =healthy world builder!": "canada",
    "victoria🇦": "victoria, bc, canada",
    "ce": "sri lanka",
    "bh": "bahrain",
    "rs": "serbia",
    "pr": "puerto rico",
    "bonny  in  rivers  state": "bonny, nigeria",
    "kenya-nairobi": "nairobi, kenya",
}
