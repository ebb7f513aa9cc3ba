"""Detector patterns, labels, word lists and lookup tables that results depend on.

Patterns are for Java's regex engine with Unicode classes and line-feed-only line ends (prefix ``U``).
"""

# ---- fixed values: fragments ----
U = "(?Ud)"
I = "(?Udi)"  # noqa: E741
MONTHS = "январ[ья]|феврал[ья]|март[а]?|апрел[ья]|ма[йя]|июн[ья]|июл[ья]|август[а]?|сентябр[ья]|октябр[ья]|ноябр[ья]|декабр[ья]"
YEAR_MARK = r"(?:\s*(?:г\.?|год[а]?))?"
NUMERIC_DATE = r"\d{1,2}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{4}"
ANY_DATE = NUMERIC_DATE + r"|\d{1,2}\s+(?:" + MONTHS + r")\s+\d{4}" + YEAR_MARK
ITEM = r"\s*(?:\d+\s*[.)]\s*)?"
WORD = "[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"
PATRONYMIC = r"[А-ЯЁ][а-яё]+(?:ович|евич|иевич|ич|овна|евна|иевна|ьевна|ична|инична|оглы|кызы)\b"
SURNAME_END = "(?:ов|ова|ев|ева|ёв|ёва|ин|ина|ын|ына|ский|ская|цкий|цкая|ко|енко|ук|юк|чук|щук|дзе|швили|ян)"
SURNAME = "[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?" + SURNAME_END
UPPER_WORD = "[А-ЯЁ]{2,}(?:-[А-ЯЁ]{2,})?"
UPPER_PATRONYMIC = "[А-ЯЁ]+(?:ОВИЧ|ЕВИЧ|ИЕВИЧ|ЬЕВИЧ|ИЧ|ОВНА|ЕВНА|ИЕВНА|ЬЕВНА|ИНИЧНА|ИЧНА|ОГЛЫ|КЫЗЫ)"
INITIALS = r"[А-ЯЁ]\.\s*[А-ЯЁ]\."
CODE = r"(?=[A-ZА-ЯЁ0-9/._\-]*\d)[A-ZА-ЯЁ0-9][A-ZА-ЯЁ0-9/._\-]{2,}"
FIO_LABEL = r"(?:ф\.?\s*и\.?\s*о\.?|фамилия\s*[,.]?\s*и(?:мя)?\.?\s*[,.]?\s*о(?:тчество)?\.?(?:\s*\(при\s+наличии\))?)"
NOT_STAFF = r"(?!\s+(?:врач\w*|доктор\w*|медсестр\w*|зав\w*|фельдшер\w*))"
OF_PATIENT = r"(?:\s+(?:пациент\w*|ребенк\w*|больн\w*))?"
PATIENT_ROLE = r"(?:пациент\w*|больн(?:ой|ая|ого|ому|ым|ых)|пострадавш\w*|(?:законн\w+\s+)?представител\w*|ф\.?\s*и\.?\s*о\.?\s*пациент\w*)"
FIELD_WORD = "(?:Дата|Время|Возраст|Номер|Пол|Телефон|Тел|Адрес|Год|Диагноз|Отделение|Место|Полис|СНИЛС|Паспорт|Врач|Пациент|Представитель|Жалобы|Анамнез|Рост|Вес|Наименование|Отделения)"
SAFE_NAME = rf"(?!{FIELD_WORD}\b)(?:[А-ЯЁ][а-яё]+|[А-ЯЁ]\.)"
NAME_GAP = r"(?:\s+|(?<=\.))"
STAFF_ROLE = (
    r"(?:врач\w*|доктор\w*|медсестр\w*|медбрат\w*|фельдшер\w*|акушер\w*|заведующ\w*|ординатор\w*|лаборант\w*|рентгенолог\w*|реаниматолог\w*|"
    r"исполнител\w*|владелец|подписант\w*|сотрудник\w*|специалист\w*|оператор\w*|подтвердил\w*|проверил\w*|выполнил\w*|составил\w*|согласовал\w*|ответственн\w+\s+лиц\w*)"
)
BIRTH_ABBREVIATION = r"г\.?\s*р(?:\.|\b(?![а-яё]))"
AGE_UNIT = r"(?:год(?:а|у|ов)?|лет|г\.|л\.)"
ADDRESS_LABEL = (
    r"(?:адрес(?!\s+(?:электронн\w+|эл\.))(?:\s+[а-яё]+){0,5}|по\s+адресу|место\s+(?:жительств\w*|регистрации|прожив\w*|пребывани\w*)"
    r"|регистрация\s+по\s+месту\s+(?:жительств\w*|пребывани\w*)|прописка(?:\s+[а-яё]+){0,3}|домашн\w+\s+адрес|фактическ\w+\s+адрес(?:\s+[а-яё]+){0,3})"
)

# ---- fixed values: identifiers ----
EMAIL = U + r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = U + r"(?<!\w)(?:\+7|7|8)?[\s\-()]*\d{3}[\s\-()]*\d{3}[\s\-()]*\d{2}[\s\-()]*\d{2}(?!\w)"
INTL_PHONE = U + r"(?<!\w)\+\d(?:[\s\-().]*\d){8,14}(?!\w)"
STRICT_PHONE = U + r"(?<!\w)(?:(?:\+7|8|7)[\s\-()]*\d{3}[\s\-()]*\d{3}[\s\-()]*\d{2}[\s\-()]*\d{2}|9\d{2}[\s\-()]*\d{3}[\s\-()]*\d{2}[\s\-()]*\d{2})(?!\w)"
OCR_PHONE = I + r"(?<!\w)(?:\+\s*)?[aа]?\s*\+\s*[aа]?\s*\d{1,3}\s+\d{3}\s+\d{3}\s+\d{2,4}(?!\d)"
SNILS = U + r"(?<!\d)\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{2}(?!\d)"
SNILS_LABELLED = I + r"(\bснилс\b\s*[:№\-]?\s*)" + SNILS[len(U):]
INN = I + r"(\bинн\b\s*[:\-]?\s*)\d{10,12}"
POLICY = I + r"(\b(?:полис|полиса)\b[^\d]{0,60})\d{8,25}"
POLICY_NUMBER = I + r"(№\s*медицинского\s+страхового\s+полиса\s+)\d+"
POLICY_DATE = I + r"(дата\s+выдачи\s+полиса[^:\n]*:\s*)[^\n]+"
SICK_LEAVE = I + r"(лист(?:ок|ка|а)?\s+нетрудоспособности\b[^\d]{0,60}(?:№|номер)\s*[:\-]?\s*)(\d{4,})"
ENP = U + r"(?<!\d)\d{4}\s?\d{4}\s?\d{4}\s?\d{4}(?!\d)"
PASSPORT = U + r"(?<!\d)\d{2}\s?\d{2}\s?\d{6}(?!\d)"
PASSPORT_SERIES = I + r"(\bсерия\b\s*[:\-]?\s*)(\d{2}\s*\d{2})"
PASSPORT_CONTEXT = I + r"\b(паспорт|документ\W*удостоверяющий\W*личность|серия)\b"
PASSPORT_IN_CONTEXT = I + r"(\b(?:паспорт|документ\W*удостоверяющий\W*личность|серия)\b[^\n]*?(?:№|\bno\.?|\bномер\b)\s*[:\-]?\s*)(\d{4,10})"
IDENTIFIER = I + r"(\bидентификатор\w*\s*[:№\-]?\s*)(?=[A-ZА-ЯЁ0-9/._\-]{6,}\b)(?=[A-ZА-ЯЁ0-9/._\-]*\d)[A-ZА-ЯЁ0-9][A-ZА-ЯЁ0-9/._\-]{5,}"
RECORD_INLINE = I + r"((?:№|номер)?\s*(?:медицинск\w*\s+)?карт\w*|(?:№|номер)?\s*истори[ия]\s+болезни|номер\s+иб|\bиб)(\s*[:№\-]?\s*)" + CODE
RECORD_HEADER = I + r"(\bмедицинск\w*\s+карт\w*(?:(?!\n|\r).){0,140}?(?:№|номер)\s*[:\-]?\s*)(" + CODE + ")"
LEADING_RECORD = I + r"^(\s*(?:№|no\.?|номер)\s*[:\-]?\s*)(" + CODE + ")(.*)$"
CARD_LABEL_ONLY = I + r"^\s*(?:№|номер)\s*карты\b\s*[:\-]?\s*$"
CARD_CONTEXT = I + r"(?:№|\bномер)\s*(?:карты|истори[ияй](?:\s+болезни)?|иб\b|и\.\s*б\.)"
CARD_LABEL_INLINE = I + r"(?:\bмедицинск\w*\s+карт\w*[^\n]*?(?:№|номер)|(?:№|номер)[^\n]*?\bмедицинск\w*\s+карт\w*)"
NOT_CARD_NUMBER = I + r"^\s*номер\s+(?:телефона|телефонов|образца|образцов|направления|направлений|протокола|протоколов|пробы|проб|анализа|анализов|заказа|заказов|полиса|снилс|паспорта|документа|истории|страхового|страхования)\b"
PHONE_LABEL = I + r"\b(?:номер\s+телефона|контактн\w+\s+телефон|телефон|тел\.?|моб\.?|сот\.?)\b"
ORG_ID = I + r"\b(?:кпп|огрн(?:ип)?|окпо|октмо|оквэд|бик)\b"
DOC_NUMBER = I + (
    r"№\s*(?:образц\w*|направлен\w*|протокол\w*|анализ\w*|заказ\w*|пробы|биоматериал\w*)|номер\s+(?:образц\w*|направлен\w*|протокол\w*|пробы)"
    r"|(?<![а-яёa-z])б\s*[/\\]\s*р\b|\bрецепт\w*|\bбланк\w*\s+рецепт\w*|\bльготн\w+\s+рецепт\w*"
)
CERTIFICATE = I + r"((?:\bсертификат(?:\s+(?:ключа|электронн\w+\s+подпис\w*))?|\bсерийн\w*\s+номер\s+сертификат\w*)\s*[:№\-]?\s*)([0-9A-FА-Я][0-9A-FА-Я\s:\-]{14,})"
# ---- fixed values: dates and ages ----
FLEX_DATE = U + r"(?<!\d)(\d{1,2})\s*[.\-/]\s*(\d{1,2})\s*[.\-/]\s*(\d{4})(?!\d)"
MONTH_DATE = I + r"\b(\d{1,2})\s+(январ[ья]|феврал[ья]|март|марта|апрел[ья]|май|мая|июн[ья]|июл[ья]|август|августа|сентябр[ья]|октябр[ья]|ноябр[ья]|декабр[ья])\s+(\d{4})" + YEAR_MARK + r"\b"
QUOTED_DAY = I + r"[«\"'‹„”]\s*(\d{1,2})\s*[»\"'›“”]\s*(?=(?:" + MONTHS + r")\b)"
MONTH_NUMBERS = {
    "января": 1, "январь": 1, "февраля": 2, "февраль": 2, "марта": 3, "март": 3, "апреля": 4, "апрель": 4, "мая": 5, "май": 5, "июня": 6, "июнь": 6,
    "июля": 7, "июль": 7, "августа": 8, "август": 8, "сентября": 9, "сентябрь": 9, "октября": 10, "октябрь": 10, "ноября": 11, "ноябрь": 11, "декабря": 12, "декабрь": 12,
}
STATED_AGE = I + r"\b(\d{1,3})\s*(год|года|лет|г\.|л\.)\b"
BARE_AGE = I + r"^\s*(\d{1,3})\s*$"
DOB_DATE_INLINE = I + r"(\bдата\s*рождения\s*[:\-]\s*)(" + ANY_DATE + ")"
DOB_LABEL_ANY = I + r"дата\s+рождени\w*"
DOB_LABEL_START = I + r"^\s*(?:\d+\s*[.)]\s*)?дата\s+рождени"
DOB_RESIDUAL = I + r"дата\s+рождени\w*.{0,100}(?:" + ANY_DATE + ")"
SEX_AGE_DOB = I + r"(\bпол\s*/\s*возраст\s*[:\-]\s*(?:муж(?:ской)?|жен(?:ский)?)\s*/\s*)(\d{1,3})\s*/\s*\d{1,2}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{4}"
BARE_DATE_LINE = U + r"^\s*(\d{1,2})\s*[.\-/]\s*(\d{1,2})\s*[.\-/]\s*(\d{4})\s*$"
DATE_ONLY_LINE = U + r"^\s*\d{1,2}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{4}\s*[гл]?\.?\s*$"
BIRTH_YEAR_BEFORE = I + r"\b((?:19|20)\d{2})\s*(?:" + BIRTH_ABBREVIATION + r"|года?\s+рожд\w*)"
BIRTH_YEAR_AFTER = I + r"(?:\b" + BIRTH_ABBREVIATION + r"|\bгод\s+рождения)\s*[:\-]?\s*((?:19|20)\d{2})\b"
POLICY_DATE_CONTEXT = I + r"дата\s+выдачи\s+полис"
ORPHAN_DATE_LINE = I + r"^\s*(?:\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}|\d{1,2}\s+(?:" + MONTHS + r")\s+\d{4}" + YEAR_MARK + r")\s*$"
DOB_NEIGHBOURS = ("фио", "лет", "пол", "дата рождения", "возраст", "год рождения")
FIO_SHORT_DOB = U + r"(\[FIO\]\s*[.,;:/\-]*\s*)\d{1,2}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{2}(?!\d)"
FIO_DOB = I + r"(\[FIO\]\s*[,;:\u2013\u2014-]?\s*)(?:" + ANY_DATE + r")(\s*[(,]?\s*\d{1,3}\s*" + AGE_UNIT + r"\s*\)?)?"
DOB_TABLE = I + rf"^({ITEM}дата\s+рождени\w*(?:[ \t]{{2,}}|\t+))(\S.*?)\s*$"
DOB_LABEL_REST = I + r"^(дата\s*рождения\b\s*[:\-]?\s*)(.*)$"
DOB_LINE = I + rf"^({ITEM}дата\s+рождени\w*)\b(.*)$"
DOB_SPLIT = I + r"(\bдата\s*рождения\s*[:\-]?\s*)число\s*(\d{1,2})\s*месяц\s*([а-яё]+)\s*год\s*(\d{4})"
DOB_AGE_ROW = I + r"(\bдата\s*рождения\s*,\s*возраст\b.*?)(\d{1,2}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{4})\s*[,;]?\s*(\d{1,3}\s*(?:год|года|лет|г\.|л\.))"
AGE_INLINE = I + rf"^({ITEM}возраст\s*[:\-]\s*)(.+)$"
FIELD_INSIDE = I + r"[а-яё]+\s*[:\-]\s*"
ANY_RAW_DATE = U + r"\d{1,2}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{2,4}"
AGE_CONTEXT = I + r"\[FIO\]|возраст|рождени|ф\.?\s*и\.?\s*о|пациент|больн"
DOB_WITH_AGE = I + r"(?:" + ANY_DATE + r")(?:\s*[/,;(\-\u2013\u2014]?\s*)(\d{1,3}\s*" + AGE_UNIT + ")"
FIO_ONLY_LINE = U + r"^\s*\[FIO\],?\s*$"
# ---- fixed values: names ----
FIO_TRIPLET = U + rf"\b{WORD}\s+{WORD}\s+{PATRONYMIC}"
FIO_WITH_INITIALS = U + rf"\b{SURNAME}\s+{INITIALS}"
FIO_UPPER_TRIPLET = U + rf"\b{UPPER_WORD}\s+{UPPER_WORD}\s+{UPPER_PATRONYMIC}\b"
FIO_UPPER_INITIALS = U + rf"\b{UPPER_WORD}\s+{INITIALS}"
FIO_INITIALS_UPPER = U + rf"\b{INITIALS}\s+{UPPER_WORD}\b"
FIO_LINES = tuple(U + rf"^\s*{x}\s*$" for x in (rf"{WORD}\s+{WORD}\s+{PATRONYMIC}", rf"{SURNAME}\s+{WORD}", rf"{SURNAME}\s+{INITIALS}", rf"{UPPER_WORD}\s+{UPPER_WORD}\s+{UPPER_PATRONYMIC}", rf"{UPPER_WORD}\s+{INITIALS}"))
FIO_INLINE_LABEL = I + rf"^({ITEM}{FIO_LABEL}{NOT_STAFF}{OF_PATIENT}\s*[:\-]\s*)(\S.+?)\s*$"
FIO_LABEL_ONLY = I + rf"^{ITEM}(?:{FIO_LABEL}{NOT_STAFF}{OF_PATIENT}|пациент\w*)\s*[:\-\.]?\s*$"
NAME_PART_LABELS = tuple(I + rf"^({ITEM}{x}\s*[:\-]\s*)(\S.+?)\s*$" for x in ("фамилия", "имя", r"отчество(?:\s*\(при\s+наличии\))?"))
FIO_NO_COLON = I + rf"^({ITEM}{FIO_LABEL}{NOT_STAFF}{OF_PATIENT}\s+)((?!(?:полностью|пациент\w*|ребенк\w*|больн\w*|врач\w*)\b)[А-ЯЁA-Z][\S].*?)\s*$"
TABLE_GAP = r"(?:[ \t]{2,}|\t+)"
NAME_PART_TABLES = tuple(I + rf"^({ITEM}{x}{TABLE_GAP})(\S.*?)\s*$" for x in ("фамилия", "имя", r"отчество(?:\s*\(при\s+наличии\))?"))
KEPT_COLUMN = r"(?:№|номер\b|отделени\w*|дата\b|направивш\w*|результат\w*|кабинет\w*|палат\w*|кем\b|пол\b|возраст\w*|диагноз\w*|наименовани\w*)"
STRAY_SURNAME = I + rf"^(\s*){SURNAME}(?=\s{{2,}}{KEPT_COLUMN})"
PATIENT_INLINE = U + r"\b([Пп]ациент\w*|[Бб]ольн\w*|[Пп]острадавш\w*)\s+((?:[А-ЯЁ][а-яё]+|[А-ЯЁ]\.)(?:\s*(?:[А-ЯЁ][а-яё]+|[А-ЯЁ]\.)){0,2})"
PATRONYMIC_LINE = U + r"^\s*[А-ЯЁ][а-яёА-ЯЁ]+(?:ович|евич|иевич|ьевич|овна|евна|иевна|ьевна|инична|оглы|кызы)\s*$"
PATIENT_LABEL_FIO = U + rf"\b((?iu:{PATIENT_ROLE})\s*[:\-]\s*)({SAFE_NAME}(?:{NAME_GAP}{SAFE_NAME}){{0,2}})"
PATIENT_MARKER = I + rf"\b{PATIENT_ROLE}\s*[:\-]"
STAFF_LABEL_VALUE = U + rf"((?iu:\b(?:фио\s+)?(?:лечащ\w+\s+)?{STAFF_ROLE}\b)(?:\s*:\s*|\s+[-\u2013\u2014]\s+))((?:[А-ЯЁ][а-яё]+|[А-ЯЁ]{{2,}}|[А-ЯЁ]\.)(?:{NAME_GAP}(?:[А-ЯЁ][а-яё]+|[А-ЯЁ]{{2,}}|[А-ЯЁ]\.)){{0,2}})"
STAFF_LABEL_ONLY = I + rf"^\s*(?:фио\s+)?(?:лечащ\w+\s+)?{STAFF_ROLE}\s*[:\-]?\s*$"
OCR_FIO_LABEL = I + (
    r"(\b(?:фио|ф\.?\s*и\.?\s*о\.?|имя|фамилия)(?>(?:\s+(?:пациент\w*|больн\w*|ребенк\w*))?)\s*[:\-]?\s*|\bпациент\w*\s*[:\-]\s*)"
    r"(?!полностью\b|или\b|лиц\w*\b|законн\w*\b|больн\w*\b|пациент\w*\b|ребенк\w*\b|врач\w*\b)"
    r"([а-яё]{3,}(?:-[а-яё]{2,})?(?:\s+[а-яё]{3,}(?:-[а-яё]{2,})?){0,2}?)(?=\s+(?:возраст|пол|дата|время|номер|№|телефон|адрес|диагноз|отделение|полис|снилс|паспорт|рост|вес)\b|\s*$)"
)
CROSS_LINE = tuple(U + x for x in (
    rf"\b(?:{WORD}|{UPPER_WORD})[ \t]*\n[ \t]*(?:{WORD}|{UPPER_WORD})[ \t]+(?:{PATRONYMIC}|{UPPER_PATRONYMIC})\b",
    rf"\b(?:{WORD}|{UPPER_WORD})[ \t]+(?:{WORD}|{UPPER_WORD})[ \t]*\n[ \t]*(?:{PATRONYMIC}|{UPPER_PATRONYMIC})\b",
))
# ---- fixed values: the strict pass ----
STAFF_CONTEXT = I + rf"\b{STAFF_ROLE}\b"
STAFF_HINT = I + (
    r"\b(?:зав\.?|зам\.?|гл\.?\s*врач\w*|врач\w*|доктор\w*|медсестр\w*|медбрат\w*|фельдшер\w*|акушер\w*|заведующ\w*|ординатор\w*|интерн\w*|лаборант\w*|подпис\w*"
    r"|психолог\w*|фармаколог\w*|логопед\w*|методист\w*|инструктор\w*|дежурн\w*|деж\.)"
)
SPECIALIST = I + (
    r"\b(?:анестезиолог|нейрохирург|хирург|физиотерапевт|рефлексотерапевт|психотерапевт|терапевт|кардиолог|невролог|гинеколог|уролог|онколог|рентгенолог|радиолог|эндокринолог|офтальмолог|окулист|оториноларинголог|отоларинголог|психиатр|нарколог|дерматовенеролог|дерматолог"
    r"|венеролог|инфекционист|ревматолог|пульмонолог|гастроэнтеролог|нефролог|колопроктолог|проктолог|травматолог|ортопед|стоматолог|патологоанатом|фтизиатр|аллерголог|иммунолог|неонатолог|реаниматолог|эпидемиолог|диетолог|гематолог|маммолог|педиатр|диагност)(?:ами|ам|ах|ов|ом|а|у|е|и|ы)?\b|\bлор\b"
)
NAME_WITH_INITIALS = U + r"\b([А-ЯЁ][а-яё]{2,})\s*,?\s*[А-ЯЁ]\.\s*[А-ЯЁ]\.?(?![а-яё])"
INITIALS_WITH_NAME = U + r"\b[А-ЯЁ]\.\s*[А-ЯЁ]\.?\s+([А-ЯЁ][а-яё]{2,})\b"
CERTIFICATE_LABEL_END = I + r"(?:\bсертификат(?:\s+(?:ключа|электронн\w+\s+подпис\w*))?|\bсерийн\w*\s+номер\s+сертификат\w*)\s*[:№\-]?\s*$"
CERTIFICATE_VALUE = U + r"^[0-9A-FА-Фа-ф][0-9A-FА-Фа-ф\s:\-]{14,}"
#: What stays of a name over two lines whose first line is masked by itself.
PATRONYMIC_BELOW = U + r"\[FIO\][ \t]*\n[ \t]*(?:[А-ЯЁ][а-яё]+(?:ович|евич|овна|евна|инична)|[А-ЯЁ]+(?:ОВИЧ|ЕВИЧ|ОВНА|ЕВНА|ИНИЧНА))\b"
OCR_UPPER_AGE = r"\d{1,3}\s*(?:ЛЕТ|ГОД(?:А|ОВ)?)"
OCR_UPPER_DEMOGRAPHICS = U + (
    r"\b[А-ЯЁ]{3,}(?:-[А-ЯЁ]{2,})?(?:\s+[А-ЯЁ]{3,}(?:-[А-ЯЁ]{2,})?){2}\s*[,;/\-]?\s*"
    rf"(?:(\d{{1,2}}\s*[.\-/]\s*\d{{1,2}}\s*[.\-/]\s*\d{{2,4}})(?:\s*[,;/\-]?\s*({OCR_UPPER_AGE}))?|({OCR_UPPER_AGE}))\b"
)
NAME_AFTER_FIO = U + r"(\[FIO\])([ \t\u00a0]+)([А-ЯЁ][А-Яа-яёЁ]{2,})"
NAME_BEFORE_FIO = U + r"([А-ЯЁ][А-Яа-яёЁ]{2,})([ \t\u00a0]+)(\[FIO\])"
PREFIX_OF_FIO = U + r"\b[А-ЯЁ][а-яё]{1,3}-\[FIO\]"
PASSPORT_NUMBER_ONLY = I + r"^\s*(?:№|no\.?|номер)\s*[:\-]?\s*$"
INITIAL_TOKEN = U + r"(?<![А-Яа-яЁё])[А-ЯЁ]\."
PATRONYMIC_END = "(?Udi)(?:ович|евич|иевич|ьевич|ич|овна|евна|иевна|ьевна|ична|инична|оглы|кызы)$"
NON_NAME_END = "(?Udi)(?:ый|ое|ые|ым|ому|ение|ения|ений|ание|ания|аний|ость|ости|ство|ства|ура|уры)$"
# ---- fixed values: contexts ----
DOCTOR_CONTEXT = I + (
    r"\b(?:врач\w*|доктор\w*|лечащ\w+\s+врач\w*|фио\s+врач\w*|зав(?:едующ\w+)?\.?\s*отделени\w+|заведующ\w*|начальник\w*|медсестр\w*|медбрат\w*|фельдшер\w*|акушер\w*|ординатор\w*|интерн\w*"
    r"|подпис\w+\s+врач\w*|медицинск\w+\s+работник\w*|медработник\w*|фио\s+медицинск\w+\s+работник\w*|лаборант\w*|рентгенлаборант\w*|специалист\w*)\b"
    r"|\b(?:анестезиолог|нейрохирург|хирург|физиотерапевт|рефлексотерапевт|психотерапевт|терапевт|кардиолог|невролог|гинеколог|уролог|онколог|рентгенолог|радиолог|эндокринолог|офтальмолог|окулист"
    r"|оториноларинголог|отоларинголог|психиатр|нарколог|дерматовенеролог|дерматолог|венеролог|инфекционист|ревматолог|пульмонолог|гастроэнтеролог|нефролог|колопроктолог|проктолог|травматолог|ортопед"
    r"|стоматолог|патологоанатом|фтизиатр|аллерголог|иммунолог|неонатолог|реаниматолог|эпидемиолог|диетолог|гематолог|маммолог|педиатр|диагност)(?:ами|ам|ах|ов|ом|а|у|е|и|ы)?\b"
)
DOCTOR_ROLE = I + r"\bврач\w*|\bдоктор\w*|медсестр\w*|медбрат\w*|фельдшер\w*|акушер\w*|подпис\w*|заведующ\w*|\bзав\.?\s*отделени|ординатор\w*|\bинтерн\w*|медицинск\w+\s+работник\w*|медработник\w*|\bлаборант\w*"
DEPARTMENT = I + r"отделени\w*|кабинет\w*"
DOCTOR_LABEL_ONLY = I + r"^\s*(?:фио\s+)?(?:лечащ\w+\s+)?(?:врач\w*|доктор\w*)\s*[:\-]?\s*$"
DOCTOR_LABEL_END = I + r"(врач\w*|доктор\w*|медсестр\w*|фельдшер\w*|медицинск\w+\s+работник\w*|медработник\w*|зав(?:едующ\w+)?\.?\s*отделени\w*)\s*[:\-]?\s*$"
SIGNATURE_ONLY = I + r"^\s*подпис\w*\s*[:\-]?\s*$"
STUDY_SIGNATURE = I + r"дата\s+проведения|дата\s+исследовани|дата\s+подписи|исследовани|заключени|протокол|подпис\w*|врач\w*|доктор\w*|медицинск\w+\s+работник\w*|медработник\w*"
LAB_HEADER = I + r"комментарий\s+подтвердил|наименовани\w*\b.{0,60}результат\w*\b.{0,80}(?:реф\.|референс\w*|ед\.\s*изм)"
STUDY_NAME = I + r"\b(?:исследовани\w*|определени\w*)\s+(?:уровня|активности|содержани\w*|концентраци\w*|числа|количества)\b"
STUDY_STOP = I + (
    r"данные\s+о\s+пациенте|ф\.?\s*и\.?\s*о\.?\s*(?:пациент\w*)?\s*[:\-]|\bфамилия\b|\bимя\b|\bотчество\b|дата\s+рождени|\bвозраст\b|год\s+рождени"
    r"|\bадрес\b|место\s+жительств|\bполис\b|\bснилс\b|\bпаспорт|телефон|\bпациент\w*\s*[:\-]|представител"
)
CLINICAL_LINE = I + rf"^{ITEM}(?:план\s+обследовани\w*|план\s+лечени\w*|план\s+ведени\w*|обследовани\w*|назначени\w*|рекомендац\w*|жалоб\w*|анамнез\w*|диагноз\w*|протокол\w*)\b"
NUMBERED_ITEM = U + r"^\s*\d+\s*[.)]\s*\S"
VALUE_STOP = I + rf"^{ITEM}" + (
    r"(?:поступил|состояние|кем\s+доставл|признак|повторная|аналогичных|санитарно|период|количество|сведения|номер\s+медицинск|фамилия|имя|отчество|фио|пациент|снилс|серия|паспорт|"
    r"контактн\w+\s+телефон|номер\s+телефона|телефон|тел\.|моб\.|сот\.|email|e-?mail|полис|инн|пол\b|дата\s+рождения|возраст|год\s+рождения|жалобы|анамнез|диагноз|объективно|осмотр|температура|"
    r"место\s+работы|должность|код\s+диагноза|обоснование\s+направления|место\s+(?:жительств|регистрации|прожив|пребывани)|адрес\b|регистрация\s+по\s+месту|прописка|домашн\w+\s+адрес|отделение|врач|доктор)"
)
# ---- fixed values: addresses, work ----
ADDRESS_ONLY = I + rf"^{ITEM}{ADDRESS_LABEL}\s*[:\-]?\s*$"
ADDRESS_INLINE = I + rf"^({ITEM}{ADDRESS_LABEL}\s*[:\-]\s*)(\S.+)$"
ADDRESS_MIDLINE = I + rf"({ADDRESS_LABEL}\s*[:\-]\s*)\S[^\n]*"
LIVES_IN = I + r"\bпрожива\w+\b\s+(?:в|во|по\s+адресу)\b[^\r\n]*"
ADDRESS_STRONG = I + (
    r"(?:\b(?:улиц\w*|проспект\w*|переул\w*|шоссе|бульвар\w*|набережн\w*|площад\w*|проезд\w*|микрорайон\w*|станиц\w*|хутор\w*|садовое\s+товарищ\w*)\b"
    r"|(?<![а-яё])(?:ул|пр-?т|пр-?д|пер|б-р|наб|пл|мкр|снт|тер)\.)"
)
ADDRESS_WEAK = I + (
    r"(?:\b(?:город|област\w*|край|республик\w*|дом|квартир\w*|корпус\w*|строени\w*|литер\w*|офис\w*|помещени\w*|посёлок|поселок|село|деревн\w*)\b"
    r"|(?<![а-яё])(?:г|обл|респ|д|кв(?!\.\s?м\b)|корп|кор|стр|лит|оф|пос|дер|п)\.)"
)
POSTAL_INDEX = U + r"^\s*\d{6}\s*,"
WORKPLACE = I + rf"^({ITEM}место\s+работы\b(?:\s*[,/]?\s*должность\b)?\s*[:\-]?\s*)(\S.+?)\s*$"
POSITION = I + rf"^({ITEM}должность\s*[:\-]?\s*)(\S.+?)\s*$"
# ---- fixed values: layout ----
TERMINATORS = (".", "!", "?", "…")
ABBREVIATION_END = I + r"(?:^|[\s(«\"])(?:гг?|мин|час|сек|ул|д|кв|корп|стр|обл|респ|пос|дер|им|тел|руб|коп|мл|мг|мкг|см|мм|кг|шт|табл|амп|мес|нед|сут|др|пр|рис|прим|№)\.$"
DANGLING_END = I + r"(?:^|\s)(?:в|во|с|со|на|по|к|ко|у|из|изо|от|ото|для|при|над|под|о|об|обо|за|до|перед|через|между|и|а|но|или|что|чтобы|как|чем|же)$"
REFLOW_DATE_LINE = U + r"^\s*\d{1,2}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{2,4}\s*(?:,\s*\d{1,3}(?:\s*(?:лет|года?|л\.))?)?\s*$"
# ---- fixed values: word lists ----
ORG_GEO_STEMS = (
    "здравоохран министерств республик больниц учрежден организац отделен департамент федерац город клиническ поликлиник центр осети алани област бюджетн государствен помощ "
    "медицин медицинск скор лаборатор кабинет отдел диспансер станци служб управлен комитет академи институт университет факультет корпус имени северн южн восточн западн район "
    "поселок посёлок село край респ обл отряд подразделен специалист заведующ начальник территориальн стационар амбулатор перинатальн родильн детск взросл структурн"
).split()
CLINICAL_STEMS = (
    "цитолог гистолог биопс биоптат морфолог иммуногист соскоб пунктат анализ исследован заключен протокол рентген томограф сцинтиграф денситометр маммограф флюорограф спирометр "
    "допплер дуплекс триплекс щитовидн молочн предстательн брюшн грудн забрюшинн лимфоуз желчн поджелуд сосудист новообразован ультразвук эндоскоп колоноскоп гастроскоп ирригоскоп"
).split()
CLINICAL_WORDS = "узи кт мрт мскт экг ээг эхо ктг фгдс эгдс фвд ро рг оак оам бак ифа пцр соэ нсг вич спид hiv эхокг рэг мскткг из по на от для при над под без во со об до и с в к".split()
NOT_NAMES = (
    "января февраля марта апреля мая июня июля августа сентября октября ноября декабря январь февраль март апрель июнь июль август сентябрь октябрь ноябрь декабрь "
    "результат наименование комментарий значение заключение понедельник вторник среда четверг пятница суббота воскресенье отделение направление диагноз возраст пациент пациента "
    "дата имя фамилия отчество пол подпись номер паспорт снилс полис телефон адрес время протокол образец образца место работа должность документ профессия гражданство "
    "национальность регистрация организация учреждение страховая"
).split()
FIRST_NAMES = (
    "Александр Алексей Анатолий Андрей Антон Аркадий Арсений Артём Артем Артур Богдан Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир Владислав Вячеслав Геннадий "
    "Георгий Глеб Григорий Даниил Данил Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин Лев Леонид Максим Марк Матвей Михаил Никита Николай Олег Павел Пётр Петр "
    "Роман Руслан Светослав Семён Семен Сергей Станислав Степан Тимофей Тимур Фёдор Федор Эдуард Юрий Ян Ярослав "
    "Александра Алёна Алена Алина Алла Анастасия Ангелина Анжела Анна Антонина Валентина Валерия Варвара Вера Вероника Виктория Галина Дарья Диана Евгения Екатерина Елена "
    "Елизавета Жанна Зинаида Зоя Инна Ирина Карина Кристина Ксения Лариса Лидия Любовь Людмила Маргарита Марина Мария Надежда Наталья Наталия Нина Оксана Ольга Полина Раиса "
    "Регина Светлана София Софья Тамара Татьяна Ульяна Юлия Яна"
).split()
_NAMES_LONGEST_FIRST = "|".join(sorted(FIRST_NAMES, key=len, reverse=True))
DICTIONARY_FIO = (U + rf"\b(?=[А-ЯЁ])(?:{_NAMES_LONGEST_FIRST})\s+{WORD}(?:\s+{WORD})?", U + rf"\b{WORD}\s+(?:{_NAMES_LONGEST_FIRST})\b")
# ---- fixed values: audit, formats, phases ----
AUDIT_ORDER = (
    ("ТЕЛЕФОН", STRICT_PHONE), ("ТЕЛЕФОН-МЕЖД", INTL_PHONE), ("ТЕЛЕФОН-OCR", OCR_PHONE), ("EMAIL", EMAIL), ("СНИЛС", SNILS), ("ИНН", INN), ("ИДЕНТИФИКАТОР", IDENTIFIER), ("ПАСПОРТ", PASSPORT),
    ("МЕДКАРТА", RECORD_INLINE), ("МЕДКАРТА-ЗАГОЛОВОК", RECORD_HEADER), ("ФИО-ТРИПЛЕТ", FIO_TRIPLET), ("ФИО-ИНИЦИАЛЫ", FIO_WITH_INITIALS), ("ФИО-КАПС", FIO_UPPER_TRIPLET),
    ("ФИО-СОТРУДНИКА", STAFF_LABEL_VALUE), ("ФИО-OCR", OCR_FIO_LABEL), ("ГОД-РОЖДЕНИЯ", BIRTH_YEAR_BEFORE), ("ДАТА-ПОЛ-ВОЗРАСТ", SEX_AGE_DOB), ("ЛИСТ-НЕТРУДОСП", SICK_LEAVE),
)
NUMERIC_KINDS = ("ТЕЛЕФОН", "ТЕЛЕФОН-МЕЖД", "СНИЛС")
FIO_KINDS = ("ФИО-ТРИПЛЕТ", "ФИО-ИНИЦИАЛЫ", "ФИО-КАПС")
TEXT_FORMATS = (".txt", ".docx", ".rtf", ".odt", ".odg", ".xlsx", ".xlsm")
IMAGE_FORMATS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp")
PHASES = {"ocr": (0.05, 0.48), "anonymize": (0.05, 0.48), "finalize": (0.54, 0.10), "render": (0.66, 0.21), "audit": (0.89, 0.09)}
#: Labels that stand alone on a line, and the tag of the value on the next line that is not blank.
LABEL_LINES = (
    ("SNILS", I + rf"^{ITEM}снилс\b\s*[:\-]?\s*$"),
    ("WORKPLACE", I + rf"^{ITEM}место\s+работы\b(?:\s*[,/]?\s*должность\b)?\s*[:\-]?\s*$"),
    ("POSITION", I + rf"^{ITEM}должность\b\s*[:\-]?\s*$"),
    ("AGE", I + rf"^{ITEM}(?:дата\s*рождения(?:\s*,\s*возраст)?|возраст|лет)\b\s*[:\-]?\s*$"),
    ("FIO", FIO_LABEL_ONLY),
    ("FIO", I + rf"^{ITEM}(?:фамилия|имя|отчество(?:\s*\(при\s+наличии\))?)\s*[:\-]?\s*$"),
    ("FIO", STAFF_LABEL_ONLY),
    ("PASSPORT", I + r"^\s*серия\s*[:\-]?\s*$"),
    ("MEDICAL_RECORD", CARD_LABEL_ONLY),
)
STAGE_WORDS = {
    "Чтение документа": "Чтение", "Распознавание скана": "Распознавание", "Извлечение и обезличивание": "Анализ", "Создание нового PDF": "Сборка PDF",
    "Подготовка документа": "Подготовка", "Документ готов": "Готово", "Ошибка документа": "Ошибка",
}
STATUS_WORDS = {"": "Ожидает", "active": "Анализ", "done": "Обезличено", "review": "Проверить", "failed": "Ошибка"}
