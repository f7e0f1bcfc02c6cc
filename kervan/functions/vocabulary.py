"""Word lists, patterns and code points that results depend on. Nothing here is computed from data."""

from __future__ import annotations

# ---- Fixed values: code points of text normalisation ----
ZERO_WIDTH = "​‌‍⁠﻿­᠎"
WIDE_SPACES = "               　"
DASHES = "‐‑‒–—―−⁃﹘﹣－"
FOLD_FROM = "ıİşŞğĞüÜöÖçÇâÂîÎûÛ"
FOLD_TO = "iIsSgGuUoOcCaAiIuU"

# ---- Fixed values: boilerplate lines ----
BOILERPLATE = (
    r"çerez(ler)?\s+(politika|aydınlatma|kullanım|tercih|ayar)",
    r"cookie\s+(policy|consent)",
    r"kvkk|kişisel\s+verilerin\s+korunması",
    r"aydınlatma\s+metni",
    r"gizlilik\s+(bildirimi|politikası)",
    r"tüm\s+hakları\s+saklıdır",
    r"bilgi\s+toplumu\s+hizmetleri",
    r"müşteri\s+hizmetleri\s*:?\s*0\d{3}",
    r"sosyal\s+medya\s+hesap",
    r"mobil\s+uygulamayı\s+indir",
    r"app\s*store|google\s*play",
    r"sitede\s+gezinmeye\s+devam\s+ederek",
    r"tarayıcı\s+ayarlarınız",
)

# ---- Fixed values: tracking parameters ----
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid", "yclid", "mc_cid", "mc_eid", "_ga")

# ---- Fixed values: months ----
MONTHS = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")
MONTHS_SHORT = ("oca", "şub", "mar", "nis", "may", "haz", "tem", "ağu", "eyl", "eki", "kas", "ara")

# ---- Fixed values: written forms of numbers, amounts, rates, terms and instalments ----
NUMBER = r"\d[\d.,]*"
MULTIPLIER = r"(?:\s*(bin|milyon|milyar))?"
CURRENCY = r"(?:₺|\btl\b|\btry\b|türk\s+liras\w*|\$|\busd\b|dolar\w*|€|\beur\b|euro|avro|£|\bgbp\b|sterlin\w*)"
RATE = r"(?<=%\s{0,3})\d[\d.,]*|(?<![\d.,])\d[\d.,]*(?=\s*%)|(?<=yüzde\s{0,3})\d[\d.,]*"
AMOUNT_PAIR = rf"({NUMBER}){MULTIPLIER}\s*{CURRENCY}?\s*(?:-|\bile\b|\bila\b)\s*({NUMBER}){MULTIPLIER}\s*{CURRENCY}?"
TERM_UNIT = r"(ay|yıl|yil|gün|gun)\w*"
TERM_RANGE = rf"(\d+)\s*-\s*(\d+)\s*{TERM_UNIT}"
TERM_SINGLE = rf"(\d+)\s*{TERM_UNIT}"
INSTALMENTS_NAMED = r"(\d+)\s*(?:ay\w*\s*)?(?:varan\s*|kadar\s*)?taksit"
INSTALMENTS_LABEL = r"taksit\s*(?:sayısı|adedi)?\s*[:\-]?\s*(\d+)"
REWARD_TIER = rf"({NUMBER})\s*(?:tl|₺)?\s*(?:ve\s+)?(?:üzerindeki|üzerinde|üzerine|üzeri|üstü)\D{{0,60}}?({NUMBER})\s*(?:tl|₺)"

# ---- Fixed values: written forms of dates; MONTH stands for the alternation of month names ----
DAY = r"(?<!\d)(\d{1,2})(?!\d)"
YEAR = r"(?<!\d)(\d{4})(?!\d)"
DATE_NUMERIC = r"(?<!\d)(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})(?!\d)"
DATE_ANY = r"(?:(?:\d{1,2}[.\-/]\d{1,2}[.\-/]\d{4})|(?:\d{1,2}\s+(?:MONTH)\s+\d{4}))"
DATE_CANDIDATE = r"(?<!\d)\d{1,2}[.\-/]\d{1,2}[.\-/]\d{4}(?!\d)|(?<!\d)\d{1,2}\s+(?:MONTH)\s+\d{4}(?!\d)"
CLOCK_TIME = r"\s*saat\s*\d{1,2}[.:]\d{2}(?::\d{2})?"
RANGE_NUMERIC = rf"{DATE_NUMERIC}\s*-\s*{DATE_NUMERIC}"
RANGE_FULL = rf"{DAY}\s+(MONTH)\s+{YEAR}\s*-\s*{DAY}\s+(MONTH)\s+{YEAR}"
RANGE_DAYS = rf"{DAY}\s*-\s*{DAY}\s+(MONTH)\s+{YEAR}"
RANGE_YEARLESS = rf"{DAY}\s+(MONTH)\s*-\s*{DAY}\s+(MONTH)\s+{YEAR}"
# The markers' order decides, not their place in the text.
END_MARKERS = (
    rf"son\s+gün\w*\s*:?\s*({DATE_ANY})",
    rf"({DATE_ANY})\s*tarihinde\s+sona\s+er",
    rf"({DATE_ANY})\s*tarihine\s+kadar",
    rf"({DATE_ANY})\s*['’]?\w*\s+kadar",
    rf"bitiş\s*(?:tarihi)?\s*:?\s*({DATE_ANY})",
    rf"kampanya\s+bitiş\w*\s*:?\s*({DATE_ANY})",
    rf"son\s+katılım\w*\s*:?\s*({DATE_ANY})",
)
START_MARKERS = (
    rf"({DATE_ANY})\s*(?:tarihinden\s+)?itibaren",
    rf"({DATE_ANY})\s*tarihinde\s+başla",
    rf"başlangıç\s*(?:tarihi)?\s*:?\s*({DATE_ANY})",
    rf"kampanya\s+başlangıç\w*\s*:?\s*({DATE_ANY})",
)

# ---- Fixed values: participation and product limits ----
SMS_CALL = r"\b([A-ZÇĞİÖŞÜ]{3,20})\s+[Yy]az\w*\s+(\d{4})['’]?\w{0,3}\s+[Gg][öo]nder"
COUPON_CALL = r"\b([a-zA-Z][a-zA-Z0-9]{3,19})\s+kod\w*\s+(?:kullan|gir|yaz)"
LTV_OF_VALUE = r"(?:ekspertiz|gayrimenkul|konut|arac|tasit|deger)\w*\s+deger\w*\s*[^%]{0,20}%\s*(\d{1,3})"
LTV_FINANCED = r"%\s*(\d{1,3})\s*['’]?\w{0,6}\s*(?:kadar|oraninda)\s+finansman"
AGE_RANGE = r"(\d{1,2})\s*[-–]\s*(\d{1,2})\s*yas"
AGE_NEW = r"(sifir\s*(km|arac|tasit)|0\s*km)"
AGE_MOST = r"(\d{1,2})\s*yas\w*\s*kadar"
AGE_USED = r"(ikinci\s*el|2\.\s*el|2\s*el)"
TERM_LIST = r"((?:\d{1,3}\s*[,/]\s*|\d{1,3}\s+ve\s+)+\d{1,3})\s*ay"

# ---- Fixed values: bound and range words ----
MONEY_UPPER = r"kadar|varan|azami|maksimum|en\s+fazla|en\s+çok|üst\s+limit"
MONEY_LOWER = r"ve\s+üzeri|ve\s+üstü|üzerinde|başlayan|itibaren|en\s+az|asgari|minimum|alt\s+limit"
MONEY_RANGE = r"\d\s*-\s*\d|\bile\b|\bila\b|arasında|arası"
MONEY_ZERO = r"masrafsız|masraf\s+yok|ücretsiz|bedelsiz|komisyonsuz|sıfır\s+masraf|ücret\s+alınmaz"
RATE_UPPER = r"varan|kadar|azami|maksimum|en\s+fazla|en\s+çok|üst\s+limit"
RATE_LOWER = r"başlayan|itibaren|en\s+az|asgari|minimum|ve\s+üzeri|ve\s+üstü|alt\s+limit"
RATE_RANGE = r"\d\s*-\s*|%\s*\d[\d.,]*\s*-|\bile\b|\bila\b|arasında|arası"
RATE_ZERO = r"vade\s+farksız|vade\s+farkı\s+yok|vade\s+farksızdır|peşin\s+fiyatına"
LIMIT_UPPER = r"(kadar|azami|en fazla|en cok|maksimum|ustu degil)"
LIMIT_LOWER = r"(baslayan|baslamak|asgari|en az|minimum|uzeri|ve uzeri|itibaren)"

# ---- Fixed values: currencies, tested in this order ----
CURRENCIES = (
    ("TRY", r"₺|\btl\b|\btry\b|türk\s+liras"),
    ("USD", r"\$|\busd\b|abd\s+doları|\bdolar"),
    ("EUR", r"€|\beur\b|\beuro\b|\bavro\b"),
    ("GBP", r"£|\bgbp\b|\bsterlin"),
)
MULTIPLIERS = (("bin", 1_000), ("milyon", 1_000_000), ("milyar", 1_000_000_000))

# ---- Fixed values: pages ----
ALWAYS_NOISE = ("script", "style", "noscript", "iframe", "svg", "canvas", "template", "input", "button", "select", "option", "textarea")
STRUCTURE_NOISE = ("nav", "footer", "header", "aside")
STRUCTURE_MAX_RATIO = 0.4
NOISE_ATTR = r"cookie|consent|kvkk|gdpr|cerez|çerez|breadcrumb|social-share|share-button|newsletter|popup|modal|back-to-top|skip-link|site-footer|site-header"
MAIN_TAGS = ("main", "article")
MAIN_IDS = ("main-content", "content")
MAIN_CLASSES = ("campaign-detail", "kampanya-detay", "content-detail", "page-content")
MAIN_MIN_RATIO = 0.3
BLOCK_TAGS = ("p", "div", "section", "article", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "dt", "dd", "ul", "ol", "table")
TITLE_PLACEHOLDER = r"\{\{|\}\}|\$\{|[\"']\s*\+|\+\s*[\"']"
SECTION_HEADING = r"kampanya koşul|koşullar|kampanya dışı|sıkça sorulan|nasıl katıl|başvuru|detaylar"
CLIMB_LIMIT = 3
SOFT_404_TITLES = (r"\b404\b", r"sayfa bulunamadı", r"page not found")
SOFT_404_BODIES = (
    r"aradığınız sayfa.{0,30}(bulunamadı|yok)",
    r"sayfa bulunamadı",
    r"böyle bir sayfa (yok|bulunmuyor)",
    r"aradığınız içeriğe ulaşılamadı",
    r"page not found",
    r"error 404",
)
SOFT_404_SCAN = 2000

# ---- Fixed values: rate tables ----
COLUMN_ALIASES = {
    "term_months": ("vade",),
    "profit_rate_pct": ("kar payi orani", "kar payi", "oran"),
    "allocation_fee_pct": ("tahsis ucreti", "tahsis"),
    "monthly_cost_pct": ("aylik toplam maliyet", "aylik maliyet"),
    "annual_cost_pct": ("yillik toplam maliyet", "yillik maliyet"),
}
VARIANT_MARKERS = (
    ("sigortasiz", "sigortasiz"),
    ("sigortali", "sigortali"),
    ("enerji sinifi a", "enerji_a"),
    ("enerji sinifi b", "enerji_b"),
    ("sifir konut", "sifir_konut"),
    ("ikinci el konut", "ikinci_el_konut"),
    ("sifir arac", "sifir_arac"),
    ("ikinci el arac", "ikinci_el_arac"),
)
CAPTION_LOOKBACK = 12
CAPTION_MIN = 20
MIN_FILLED = 2

# ---- Fixed values: forms ----
IGNORED_INPUTS = ("hidden", "submit", "button", "reset", "image", "file", "password")
NOTICE_HINTS = ("bilgi amaclidir", "bilgilendirme amaclidir", "baglayici", "temsili", "ornek niteligindedir", "kesin fiyat")
AMOUNT_HINTS = ("tutar", "amount", "miktar", "kredi", "finansman")
TERM_HINTS = ("vade", "term", "taksit", "ay")
FULL_LIMIT, GRID_LIMIT, GRID_POINTS = 60, 2_000, 4
VARIANT_RULES = (
    ("konut_durumu", "kentsel_donusum", ("kentsel donusum",)),
    ("konut_durumu", "tamamlayici_konut", ("tamamlayici konut", "tamamlayici")),
    ("konut_durumu", "toki", ("toki",)),
    ("konut_durumu", "arsa", ("arsa",)),
    ("konut_durumu", "isyeri", ("isyeri", "is yeri", "ticari gayrimenkul")),
    ("konut_durumu", "ikinci_el_konut", ("2. el konut", "2.el konut", "ikinci el konut")),
    ("konut_durumu", "sifir_konut", ("sifir konut", "0 km konut", "yeni konut")),
    ("arac_durumu", "elektrikli_arac", ("elektrikli",)),
    ("arac_durumu", "hibrit_arac", ("hibrit", "hybrid")),
    ("arac_durumu", "ticari_arac", ("ticari arac", "ticari tasit")),
    ("arac_durumu", "ikinci_el_arac", ("2. el arac", "2.el arac", "ikinci el arac", "2. el tasit", "ikinci el tasit")),
    ("arac_durumu", "sifir_arac", ("sifir arac", "0 km arac", "sifir km", "sifir tasit")),
    ("sigorta", "sigortasiz", ("sigortasiz", "sigortasi olmayan")),
    ("sigorta", "sigortali", ("sigortali",)),
    ("enerji_sinifi", "enerji_a", ("enerji sinifi a", "a sinifi", "a enerji")),
    ("enerji_sinifi", "enerji_b", ("enerji sinifi b", "b sinifi", "b enerji")),
    ("enerji_sinifi", "enerji_diger", ("diger enerji", "enerji sinifi diger")),
    ("musteri_tipi", "maas_musterisi", ("maas musteri", "maasini", "maas alan")),
    ("musteri_tipi", "kamu_calisani", ("kamu calisani", "memur")),
    ("musteri_tipi", "banka_calisani", ("banka calisani", "personel")),
    ("musteri_tipi", "yeni_musteri", ("yeni musteri", "ilk kez")),
    ("musteri_tipi", "esnaf", ("esnaf",)),
    ("musteri_tipi", "ciftci", ("ciftci", "tarim")),
    ("ozel", "karz_i_hasen", ("karz-i hasen", "karz i hasen", "karzi hasen")),
    ("ozel", "cevre_dostu", ("cevre dostu", "cevreci")),
    ("ozel", "surdurulebilirlik", ("surdurulebilir",)),
)
VARIANTS = {
    "arac_durumu": ("sifir_arac", "ikinci_el_arac", "ticari_arac", "elektrikli_arac", "hibrit_arac"),
    "konut_durumu": ("sifir_konut", "ikinci_el_konut", "kentsel_donusum", "tamamlayici_konut", "arsa", "isyeri", "toki"),
    "enerji_sinifi": ("enerji_a", "enerji_b", "enerji_diger"),
    "sigorta": ("sigortali", "sigortasiz"),
    "musteri_tipi": ("standart", "maas_musterisi", "kamu_calisani", "banka_calisani", "yeni_musteri", "esnaf", "ciftci"),
    "ozel": ("karz_i_hasen", "cevre_dostu", "surdurulebilirlik"),
}

# ---- Fixed values: provenance ----
RATE_CONFIDENCE = (("html_table", "1.000"), ("payment_plan_derived", "0.950"), ("calculator_api", "0.850"), ("calculator_playwright", "0.800"), ("text", "0.750"), ("js_default", "0.500"), ("none", "0.000"))
NOT_COMPARABLE = ("js_default", "none")
RETRYABLE = (408, 425, 429, 493)
LIST_KEYS = ("data", "items", "result", "results", "list", "campaigns")

# ---- Fixed values: the axes' labels ----
PRODUCT_TYPES = ("finansman", "ihtiyac_finansmani", "konut_finansmani", "tasit_finansmani", "kart", "alisveris_puani", "yeni_musteri", "yatirim_urunu", "birikim_katilma_hesabi", "sigorta", "pos_uye_isyeri", "dijital_bankacilik", "odeme_fatura", "kobi_ticari", "isyeri_finansmani")
SECTORS = ("market_gida", "akaryakit", "giyim_aksesuar", "elektronik_telekom", "beyaz_esya_ev", "mobilya_dekorasyon", "yapi_hirdavat", "kuyum_optik_saat", "eticaret_pazaryeri", "seyahat_konaklama", "ulasim_arac_kiralama", "restoran_kafe", "eglence_dijital", "egitim_kitap", "saglik_kozmetik", "hobi_oyuncak_spor", "vergi_fatura_kamu", "sigorta", "yatirim_birikim", "konut_gayrimenkul", "kurumsal_kobi", "genel")
AUDIENCES = ("yeni_musteri", "mevcut_musteri", "maas_musterisi", "emekli", "ogrenci", "genc", "kamu_calisani", "banka_calisani", "esnaf", "ciftci", "kobi", "ticari_kurumsal", "ozel_bankacilik", "herkes")
BENEFITS = ("nakit_iade", "puan_mil", "taksit", "vade_farksiz_taksit", "indirim", "hediye_ceki", "ucret_muafiyeti", "masrafsiz", "avantajli_kar_payi", "hediye_urun", "cekilis")
AXES = {"product_type": PRODUCT_TYPES, "sector": SECTORS, "audience": AUDIENCES, "benefit": BENEFITS}
SOURCE_CONFIDENCE = {"url": "1.000", "bank_category": "1.000", "merchant": "0.900", "keyword": "0.700"}
AMBIGUOUS_PENALTY = "0.200"
FALLBACK_SECTOR, FALLBACK_CONFIDENCE = "genel", "0.300"
EVIDENCE_MAX = 160

# ---- Fixed values: the sites' own categories ----
OWN_CATEGORY_SECTOR = {
    "kuyum, optik ve saat": "kuyum_optik_saat",
    "market ve gıda": "market_gida",
    "e-ticaret": "eticaret_pazaryeri",
    "elektronik ve telekomünikasyon": "elektronik_telekom",
    "yapı sektörü ve iklimlendirme": "yapi_hirdavat",
    "akaryakıt": "akaryakit",
    "eğitim, kitap ve kırtasiye": "egitim_kitap",
    "turizm ve seyahat": "seyahat_konaklama",
    "hobi ve oyuncak": "hobi_oyuncak_spor",
    "mobilya ve dekorasyon": "mobilya_dekorasyon",
    "beyaz eşya ve ev aletleri": "beyaz_esya_ev",
    "giyim ve aksesuar": "giyim_aksesuar",
    "diğer kampanyalar": "genel",
    "genel kampanyalar": "genel",
    "seyahat-kampanyalari": "seyahat_konaklama",
}
OWN_CATEGORY_PRODUCT = {
    "kart-kampanyalari": "kart",
    "finansman-kampanyalari": "finansman",
    "musteri-ol-kampanyalari": "yeni_musteri",
    "kobi-kampanyalari": "kobi_ticari",
    "pos-kampanyalari": "pos_uye_isyeri",
    "kart": "kart",
    "finansman": "finansman",
    "ticari": "kobi_ticari",
    "dijital_bankacilik": "dijital_bankacilik",
    "odeme": "odeme_fatura",
    "yatirim": "yatirim_urunu",
    "birikim_fon": "birikim_katilma_hesabi",
    "sigorta": "sigorta",
}

# ---- Fixed values: merchants by sector, in the order they are tried ----
MERCHANTS = {
    "eticaret_pazaryeri": ("trendyol", "hepsiburada", "n11", "pazarama", "pttavm"),
    "market_gida": ("a101", "migros", "carrefour", "şok market", "bim"),
    "giyim_aksesuar": ("lc waikiki", "lcwaikiki", "colin's", "colins", "modanisa", "abdullah kiğılı", "kiğılı"),
    "mobilya_dekorasyon": ("koçtaş", "koctas", "enza home", "istikbal", "kelebek"),
    "beyaz_esya_ev": ("schafer", "vestel"),
    "elektronik_telekom": ("apple", "teknosa", "vatan bilgisayar"),
    "seyahat_konaklama": ("pegasus", "biletinial", "tatilbudur", "setur"),
    "ulasim_arac_kiralama": ("enterprise", "rentgo", "ispark", "otopark", "otorapor", "pirelli"),
    "restoran_kafe": ("espressolab", "gastroclub"),
    "eglence_dijital": ("netflix", "spotify", "chatgpt", "disney+", "hbo max", "mubi", "exxen", "tabii", "youtube premium"),
    "egitim_kitap": ("idefix",),
    "saglik_kozmetik": ("restoderm", "sosyopix"),
    "kurumsal_kobi": ("shipentegra", "edenred"),
    "konut_gayrimenkul": ("emlak konut",),
    "hobi_oyuncak_spor": ("barçın spor", "barcin", "hızlı çiçek"),
    "kuyum_optik_saat": ("zen pırlanta", "zen pirlanta"),
}
AMBIGUOUS_MERCHANTS = ("gain", "tod", "bim", "apple", "kelebek", "setur")

# ---- Fixed values: keywords of the axes, in the order they are tried ----
PRODUCT_KEYWORDS = {
    "konut_finansmani": ("konut finansman", "ev finansman", "mortgage", "gayrimenkul finansman"),
    "tasit_finansmani": ("taşıt finansman", "araç finansman", "otomobil finansman"),
    "ihtiyac_finansmani": ("ihtiyaç finansman", "ihtiyaç kredi"),
    "isyeri_finansmani": ("işyeri finansman", "iş yeri finansman"),
    "finansman": ("finansman kullan", "finansman kampanya", "karz-ı hasen"),
    "kart": ("kredi kartı", "bankkart", "kart kampanya", "banka kartı", "kartınız"),
    "alisveris_puani": ("bankkart lira", "worldpuan", "paraf para", "puan kazan"),
    "yeni_musteri": ("yeni müşteri", "müşterimiz ol", "ilk kez", "müşteri ol"),
    "yatirim_urunu": ("yatırım fon", "hisse", "altın hesab", "döviz hesab", "kıymetli maden"),
    "birikim_katilma_hesabi": ("katılma hesab", "birikim hesab", "katılım fonu", "vadeli hesap"),
    "sigorta": ("sigorta poliçe", "sigortası", "bes ", "bireysel emeklilik"),
    "pos_uye_isyeri": ("üye işyeri", "pos cihaz", "sanal pos"),
    "dijital_bankacilik": ("mobil uygulama", "internet şube", "dijital bankacılık", "mobilden"),
    "odeme_fatura": ("fatura ödeme", "vergi ödeme", "mtv", "otomatik ödeme"),
    "kobi_ticari": ("kobi", "ticari müşteri", "esnaf", "işletme"),
}
SECTOR_KEYWORDS = {
    "market_gida": ("market", "gıda", "süt ürün", "bakliyat"),
    "akaryakit": ("akaryakıt", "benzin", "motorin", "yakıt"),
    "giyim_aksesuar": ("giyim", "ayakkabı", "tekstil", "moda", "aksesuar"),
    "elektronik_telekom": ("elektronik", "telekomünikasyon", "cep telefon", "bilgisayar"),
    "beyaz_esya_ev": ("beyaz eşya", "ev aletleri", "buzdolab", "çamaşır makine", "süpürge"),
    "mobilya_dekorasyon": ("mobilya", "dekorasyon", "koltuk", "yatak odası"),
    "yapi_hirdavat": ("yapı market", "hırdavat", "iklimlendirme", "klima", "inşaat malzeme"),
    "kuyum_optik_saat": ("kuyum", "optik", "gözlük", "pırlanta", "mücevher", "saat"),
    "eticaret_pazaryeri": ("e-ticaret", "online alışveriş", "pazaryeri", "internetten alışveriş"),
    "seyahat_konaklama": ("uçak bilet", "otel", "tatil", "seyahat", "konaklama", "turizm"),
    "ulasim_arac_kiralama": ("araç kiralama", "otopark", "toplu taşıma", "lastik", "araç bakım"),
    "restoran_kafe": ("restoran", "kafe", "yeme içme", "kahve"),
    "eglence_dijital": ("dijital abonelik", "sinema", "müzik", "oyun", "streaming"),
    "egitim_kitap": ("eğitim", "kitap", "kırtasiye", "okul", "üniversite", "kurs"),
    "saglik_kozmetik": ("sağlık", "kozmetik", "eczane", "kişisel bakım", "hastane"),
    "hobi_oyuncak_spor": ("hobi", "oyuncak", "spor", "outdoor", "çiçek"),
    "vergi_fatura_kamu": ("vergi", "fatura", "mtv", "trafik ceza", "kamu ödeme"),
    "sigorta": ("sigorta",),
    "yatirim_birikim": ("altın", "döviz", "fon", "yatırım", "birikim"),
    "konut_gayrimenkul": ("konut", "gayrimenkul", "emlak", "tapu"),
    "kurumsal_kobi": ("üye işyeri", "pos", "kurumsal", "kobi", "işletme"),
}
AUDIENCE_KEYWORDS = {
    "yeni_musteri": ("yeni müşteri", "ilk kez", "müşterimiz ol", "müşteri ol"),
    "mevcut_musteri": ("mevcut müşteri", "hâlihazırda müşteri"),
    "maas_musterisi": ("maaş müşteri", "maaşını bankamız", "maaş alan"),
    "emekli": ("emekli", "emeklilik maaş"),
    "ogrenci": ("öğrenci", "üniversiteli"),
    "genc": ("genç", "18-25"),
    "kamu_calisani": ("kamu çalışan", "memur"),
    "banka_calisani": ("banka çalışan", "personelimiz"),
    "esnaf": ("esnaf",),
    "ciftci": ("çiftçi", "tarım"),
    "kobi": ("kobi",),
    "ticari_kurumsal": ("ticari müşteri", "kurumsal müşteri", "şirket"),
    "ozel_bankacilik": ("özel bankacılık", "private banking"),
}
BENEFIT_KEYWORDS = {
    "nakit_iade": ("nakit iade", "iade kazan", "para iade", "cashback", "geri ödeme"),
    "puan_mil": ("bankkart lira", "worldpuan", "paraf para", "puan", "mil"),
    "vade_farksiz_taksit": ("vade farksız", "peşin fiyatına"),
    "taksit": ("taksit", "taksitlendirme", "aya varan taksit"),
    "indirim": ("indirim", "indirimli"),
    "ucret_muafiyeti": ("ücret alınmaz", "ücretsiz", "komisyon yok", "dosya masrafı alınmam", "sıfır komisyon"),
    "masrafsiz": ("masrafsız",),
    "hediye_ceki": ("alışveriş çeki", "hediye çeki", "hediye kartı"),
    "avantajli_kar_payi": ("avantajlı kâr payı", "özel oranlı", "düşük maliyetli finansman"),
    "hediye_urun": ("hediye ürün", "hediyeniz"),
    "cekilis": ("çekiliş", "talihli", "kura"),
}
