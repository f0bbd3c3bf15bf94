"""Word lists, tables and patterns the results depend on.

Everything in this module is a value, not logic.  Callers may pass their own
lexicon, area master or term lists wherever a function takes one.
"""

from __future__ import annotations

# --- sentinels (fixed values) ----------------------------------------------
UNKNOWN_NAME = "（建物名不明）"  # counts as "no name"
BLANK_NAME = "（建物名なし）"  # written when a list has no name; counts as a name

# --- enumerations (fixed values) -------------------------------------------
NOT_DISTRIBUTED = "NOT_DISTRIBUTED"
POSSIBLE = "POSSIBLE_DUPLICATE"
CONFIRMED = "CONFIRMED_DISTRIBUTED"
STATUSES = [NOT_DISTRIBUTED, POSSIBLE, CONFIRMED]
PROPERTY_TYPES = ["rental", "condominium", "unknown"]
COMPLETION_STATUSES = ["CONFIRMED", "HIGH", "AMBIGUOUS", "NOT_FOUND"]
RESEARCH_SOURCES = ["chatgpt", "claude", "homes", "suumo", "google_maps", "manual"]
RESEARCH_FIELDS = ["building_name", "address", "total_units", "property_type", "building_type"]
INGEST_OUTCOMES = [
    "inserted", "merged", "already_distributed", "possible_duplicate", "skipped", "excluded_use",
]
PREVIEW_PRIORITY = ["skipped", "possible_duplicate", "already_distributed", "merged", "inserted"]

# --- character classes (fixed values) --------------------------------------
# White space as the input systems understand it (wider than Java's \s).
SPACE_CLASS = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
ADDRESS_DASHES = "‐‑‒–—―ー−ｰ－"
BLOCK_DASHES = "－―ー‐‑–—−"
ADDRESS_NOISE = ",.、。，．・･:：;；'\"`|/\\_~^*!?()（）「」『』【】〔〕［］[]｛｝{}<>＜＞〒#＃@＠&＆+＋=＝"
NAME_NOISE = (
    ",.、。，．・･:：;；'\"`|/\\_~^*!?＆&＠@#＃$＄%％()（）「」『』【】〔〕［］[]｛｝{}<>＜＞+＋=＝-‐‑‒–—―−"
)
KANJI_DIGITS = "〇零一二三四五六七八九"  # 0 0 1 2 ... 9
KANJI_DIGIT_VALUES = "00123456789"

PREFECTURE_PATTERN = "^(北海道|東京都|京都府|大阪府|[^%s]{2,3}県)" % SPACE_CLASS
LOOSE_PREFECTURE_PATTERN = "^(東京都|北海道|京都府|大阪府|.{2,3}県)"
UNIT_SUFFIX_PATTERN = r"([0-9]+号室|[0-9]+号棟|[a-z]?[0-9]+棟|[0-9]+f|b[0-9]+f)$"

# --- name lexicon (fixed values): canonical token, then its spellings ------
LEXICON = [
    ("grand", ["グランド", "グラン", "grand", "gran", "gurando", "guran"]),
    ("maison", ["メゾン", "メイゾン", "maison", "mezon", "meison", "maisons"]),
    ("court", ["コート", "コウト", "court", "kohto", "koto", "courts"]),
    ("heights", ["ハイツ", "heights", "height", "haitsu"]),
    ("heim", ["ハイム", "heim", "haimu"]),
    ("haus", ["ハウス", "ハオス", "house", "haus", "hausu"]),
    ("palace", ["パレス", "パラス", "palace", "paresu", "palais"]),
    ("residence", ["レジデンス", "レジデンシャル", "residence", "residencia", "rejidensu", "residential"]),
    ("tower", ["タワー", "tower", "tawa"]),
    ("park", ["パーク", "park", "paku", "parc"]),
    ("garden", ["ガーデン", "ガーデンズ", "garden", "gardens", "gaden"]),
    ("hills", ["ヒルズ", "ヒル", "hills", "hill", "hiruzu"]),
    ("plaza", ["プラザ", "ぷらざ", "plaza", "puraza"]),
    ("corpo", ["コーポ", "コーポラス", "corpo", "kopo", "corpolus"]),
    ("villa", ["ヴィラ", "ビラ", "ヴィレッジ", "villa", "vila", "bira", "village"]),
    ("city", ["シティ", "シティー", "city", "shiti"]),
    ("stage", ["ステージ", "stage", "suteji"]),
    ("square", ["スクエア", "スクウェア", "square", "sukuea"]),
    ("terrace", ["テラス", "terrace", "terasu"]),
    ("flat", ["フラット", "flat", "furatto"]),
    ("front", ["フロント", "front", "furonto"]),
    ("avenue", ["アベニュー", "avenue", "abenyu"]),
    ("street", ["ストリート", "street", "sutorito"]),
    ("side", ["サイド", "side", "saido"]),
    ("view", ["ビュー", "ヴュー", "view", "byu"]),
    ("forest", ["フォレスト", "forest", "foresuto"]),
    ("green", ["グリーン", "green", "gurin"]),
    ("blue", ["ブルー", "blue", "buru"]),
    ("white", ["ホワイト", "white", "howaito"]),
    ("royal", ["ロイヤル", "ロイアル", "royal", "roiyaru"]),
    ("premium", ["プレミアム", "premium", "puremiamu"]),
    ("central", ["セントラル", "central", "sentoraru"]),
    ("station", ["ステーション", "station", "suteshon"]),
    ("sunrise", ["サンライズ", "sunrise", "sanraizu"]),
    ("sunshine", ["サンシャイン", "sunshine", "sanshain"]),
    ("sun", ["サン", "sun", "san"]),
    ("casa", ["カーサ", "casa", "kasa"]),
    ("belle", ["ベル", "ベール", "belle", "bell", "beru"]),
    ("ville", ["ヴィル", "ビル", "ville", "biru"]),
    ("courtyard", ["コートヤード", "courtyard", "kotoyado"]),
    ("mansion", ["マンション", "mansion", "manshon"]),
    ("apartment", ["アパート", "アパートメント", "apartment", "apart", "apato"]),
    ("building", ["ビルディング", "building", "bldg", "birudingu"]),
    ("annex", ["アネックス", "annex", "anekkusu"]),
    ("so", ["荘", "ソウ", "sou"]),
    ("kaikan", ["会館", "kaikan"]),
    ("kan", ["館", "カン"]),
    ("daiichi", ["第一", "ダイイチ", "daiichi", "daiiti"]),
    ("daini", ["第二", "ダイニ", "daini"]),
    ("daisan", ["第三", "ダイサン", "daisan"]),
    ("higashi", ["東", "ヒガシ", "higashi", "east"]),
    ("nishi", ["西", "ニシ", "nishi", "west"]),
    ("minami", ["南", "ミナミ", "minami", "south"]),
    ("kita", ["北", "キタ", "kita", "north"]),
    ("chuo", ["中央", "チュウオウ", "chuo", "chuou"]),
    ("shin", ["新", "シン", "shin"]),
    ("hon", ["本", "ホン", "hon"]),
    ("nippori", ["日暮里", "ニッポリ", "nippori", "nipori"]),
    ("arakawa", ["荒川", "アラカワ", "arakawa"]),
    ("minowa", ["三ノ輪", "三の輪", "ミノワ", "minowa"]),
    ("machiya", ["町屋", "マチヤ", "machiya"]),
    ("ogu", ["尾久", "オグ", "ogu"]),
    ("senju", ["千住", "センジュ", "senju"]),
    ("ueno", ["上野", "ウエノ", "ueno"]),
    ("asakusa", ["浅草", "アサクサ", "asakusa"]),
    ("ikebukuro", ["池袋", "イケブクロ", "ikebukuro"]),
    ("shinjuku", ["新宿", "シンジュク", "shinjuku"]),
    ("shibuya", ["渋谷", "シブヤ", "shibuya"]),
    ("tokyo", ["東京", "トウキョウ", "tokyo", "toukyou"]),
    ("akihabara", ["秋葉原", "アキハバラ", "akihabara"]),
    ("kanda", ["神田", "カンダ", "kanda"]),
    ("sugamo", ["巣鴨", "スガモ", "sugamo"]),
    ("oji", ["王子", "オウジ", "oji", "ouji"]),
    ("tabata", ["田端", "タバタ", "tabata"]),
    ("komagome", ["駒込", "コマゴメ", "komagome"]),
    ("yanaka", ["谷中", "ヤナカ", "yanaka"]),
    ("kitasenju", ["北千住", "キタセンジュ", "kitasenju"]),
]
NOISE_TOKENS = ["mansion", "apartment", "building"]

# --- building use: map tag values by category (fixed values) ---------------
USE_TAG_CATEGORY = {
    "apartments": "residential_multi", "housing": "residential_multi",
    "dormitory": "other_residential", "barracks": "other_residential", "nursing_home": "other_residential",
    "retirement_home": "other_residential",
    "house": "single_dwelling", "detached": "single_dwelling", "semidetached_house": "single_dwelling",
    "terrace": "single_dwelling", "bungalow": "single_dwelling", "cabin": "single_dwelling",
    "hut": "single_dwelling", "static_caravan": "single_dwelling", "houseboat": "single_dwelling",
    "stilt_house": "single_dwelling", "ger": "single_dwelling", "tent": "single_dwelling", "farm": "single_dwelling",
    "commercial": "commercial", "retail": "commercial", "shop": "commercial", "supermarket": "commercial",
    "kiosk": "commercial", "marketplace": "commercial", "hotel": "commercial", "motel": "commercial",
    "restaurant": "commercial",
    "office": "office", "government": "office", "civic": "office",
    "industrial": "industrial", "warehouse": "industrial", "factory": "industrial", "manufacture": "industrial",
    "hangar": "industrial", "silo": "industrial", "storage_tank": "industrial", "digester": "industrial",
    "barn": "industrial", "cowshed": "industrial", "farm_auxiliary": "industrial", "greenhouse": "industrial",
    "stable": "industrial", "sty": "industrial", "slurry_tank": "industrial",
    "school": "institutional", "university": "institutional", "college": "institutional",
    "kindergarten": "institutional", "hospital": "institutional", "clinic": "institutional",
    "public": "institutional", "fire_station": "institutional", "police": "institutional", "prison": "institutional",
    "museum": "institutional", "library": "institutional", "church": "institutional", "chapel": "institutional",
    "cathedral": "institutional", "mosque": "institutional", "temple": "institutional", "shrine": "institutional",
    "synagogue": "institutional", "monastery": "institutional", "religious": "institutional",
    "presbytery": "institutional", "sports_hall": "institutional", "sports_centre": "institutional",
    "stadium": "institutional", "grandstand": "institutional", "pavilion": "institutional",
    "riding_hall": "institutional", "train_station": "institutional", "transportation": "institutional",
    "military": "institutional", "bunker": "institutional",
    "garage": "ancillary", "garages": "ancillary", "carport": "ancillary", "parking": "ancillary",
    "shed": "ancillary", "roof": "ancillary", "service": "ancillary", "transformer_tower": "ancillary",
    "water_tower": "ancillary", "container": "ancillary", "toilets": "ancillary", "kitchen": "ancillary",
    "conservatory": "ancillary", "construction": "ancillary", "ruins": "ancillary", "tower": "ancillary",
    "boathouse": "ancillary",
    "residential": "ambiguous", "yes": "ambiguous", "building": "ambiguous", "unclassified": "ambiguous",
}
USE_LABELS = {
    "residential_multi": "集合住宅",
    "other_residential": "寮・社宅",
    "single_dwelling": "戸建て・長屋",
    "commercial": "店舗・商業施設",
    "office": "オフィス・事務所",
    "industrial": "工場・倉庫",
    "institutional": "学校・病院等の施設",
    "ancillary": "ガレージ・駐車場等",
    "ambiguous": "用途を特定できない建物",
}
# Excluding terms are tried in this order, before the residential terms.
EXCLUDING_TERMS = [
    ("店舗付き", "commercial"), ("店舗併用", "commercial"),
    ("戸建", "single_dwelling"), ("一戸建", "single_dwelling"), ("一軒家", "single_dwelling"),
    ("長屋", "single_dwelling"), ("テラスハウス", "single_dwelling"), ("タウンハウス", "single_dwelling"),
    ("寮", "other_residential"), ("社宅", "other_residential"), ("官舎", "other_residential"),
    ("老人ホーム", "other_residential"),
    ("店舗", "commercial"), ("商業施設", "commercial"), ("商業ビル", "commercial"), ("ショッピング", "commercial"),
    ("スーパー", "commercial"), ("ホテル", "commercial"), ("旅館", "commercial"), ("飲食", "commercial"),
    ("事務所", "office"), ("オフィス", "office"),
    ("工場", "industrial"), ("倉庫", "industrial"), ("作業所", "industrial"),
    ("学校", "institutional"), ("大学", "institutional"), ("高校", "institutional"), ("中学", "institutional"),
    ("小学", "institutional"), ("幼稚園", "institutional"), ("保育園", "institutional"), ("病院", "institutional"),
    ("診療所", "institutional"), ("クリニック", "institutional"), ("神社", "institutional"), ("寺院", "institutional"),
    ("教会", "institutional"),
    ("ガレージ", "ancillary"), ("駐車場", "ancillary"), ("車庫", "ancillary"), ("物置", "ancillary"),
]
RESIDENTIAL_TERMS = [
    "マンション", "アパート", "集合住宅", "共同住宅", "コーポ", "ハイツ", "メゾン", "レジデンス", "団地", "公営住宅", "都営住宅", "県営住宅", "市営住宅", "区営住宅",
]

# --- map element tags (fixed values) ---------------------------------------
NAME_TAGS = ["name:ja", "name", "official_name", "name:ja-Hira", "name:en"]
MIXED_USE_TAGS = ["shop", "office", "amenity", "tourism", "craft", "healthcare", "leisure", "club"]
NON_APARTMENT_RESIDENTIAL = [
    "dormitory", "university", "college", "retirement_home", "nursing_home", "assisted_living",
]
UNIT_TAGS = ["building:flats", "flats", "building:units"]

# --- column headers (fixed values) -----------------------------------------
LIST_HEADERS = [
    ("building_name", ["建物名", "物件名", "マンション名", "建物", "名称", "物件", "name"]),
    ("address", ["住所", "所在地", "所在", "address"]),
    ("total_units", ["総戸数", "総世帯数", "戸数", "世帯数", "部屋数", "units"]),
    ("property_type", ["種別", "物件種別", "賃貸分譲", "type"]),
    ("latitude", ["緯度", "lat", "latitude"]),
    ("longitude", ["経度", "lng", "lon", "longitude"]),
    ("prefecture", ["都道府県", "県名", "prefecture"]),
    ("city", ["市区町村", "市区郡", "区", "市", "city"]),
    ("town", ["町名", "町丁目", "大字", "town"]),
    ("building_use", ["用途", "建物用途", "building", "use", "構造"]),
]
IMPORT_HINTS = [
    ("building_name", ["建物名", "物件名", "マンション名", "建物", "名称", "物件", "name", "building"]),
    ("address", ["住所", "所在地", "所在", "address", "location"]),
    ("total_units", ["総世帯数", "世帯数", "戸数", "総戸数", "部屋数", "units", "households"]),
    ("property_type", ["種別", "物件種別", "賃貸分譲", "type"]),
    ("distributed_date", ["配布日", "実施日", "配布年月日", "日付", "date"]),
    ("distributed_by", ["担当者", "担当", "配布者", "スタッフ", "staff", "by"]),
    ("notes", ["備考", "メモ", "コメント", "note", "memo", "remarks"]),
    ("latitude", ["緯度", "lat", "latitude"]),
    ("longitude", ["経度", "lng", "lon", "longitude"]),
]

# --- hosts whose terms forbid automated reading (fixed values) -------------
BLOCKED_HOSTS = [
    "suumo.jp", "homes.co.jp", "lifull.com", "athome.co.jp", "realestate.yahoo.co.jp", "yahoo.co.jp",
    "chintai.net", "apamanshop.com", "minimini.jp", "able.co.jp", "homemate.co.jp", "rakumachi.jp",
]

# --- area master (fixed values): prefecture -> wards -----------------------
AREA_MASTER = {
    "東京都": [
        "千代田区", "中央区", "港区", "新宿区", "文京区", "台東区", "墨田区", "江東区", "品川区", "目黒区", "大田区", "世田谷区", "渋谷区", "中野区", "杉並区",
        "豊島区", "北区", "荒川区", "板橋区", "練馬区", "足立区", "葛飾区", "江戸川区",
    ],
}

