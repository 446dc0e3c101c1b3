"""Names and word lists of the record format.

Everything in this module is a fixed value: results only agree with other
tools working on the same records if these are used unchanged.
"""

# Record keys.
MASS = "массовая доля"
OTHER = "прочее"
SUBSTANCE = "вещество"
PARAMETER = "параметр"
UNIT = "единица"
VALUE = "значение"
WEIGHT = "масса"
QUANTITY = "количество"
VOLUME = "объем"

# The order in which an "other" entry is searched for its value.
OTHER_VALUE_KEYS = (WEIGHT, QUANTITY, VOLUME, VALUE)
# The order used when facts are compared (first truthy value).
FACT_VALUE_KEYS = (VALUE, WEIGHT, QUANTITY, VOLUME)

# Latin spelling of the record keys.
LATIN_KEYS = {
    "mass_fractions": MASS,
    "other_params": OTHER,
    "substance_name": SUBSTANCE,
    "mass_fraction": MASS,
    "parameter_name": PARAMETER,
    "mass": WEIGHT,
    "volume": VOLUME,
    "quantity": QUANTITY,
    "value": VALUE,
    "unit": UNIT,
}

# Cyrillic letters and the latin letters they look like.
HOMOGLYPHS_FROM = "АВСЕНКМОРТХуавекмнорстх"
HOMOGLYPHS_TO = "ABCEHKMOPTXyabekmhopctx"

# Words that introduce the answer in a response, in search order.
ANSWER_MARKERS = ("ответ:", "answer:")

# Phrases that show a response repeats its instruction.
INSTRUCTION_PHRASES = (
    "пожалуйста выполните",
    "пожалуйста выполни",
    "выполните задание",
    "выполни задание",
    "пожалуйста найдите",
    "пожалуйста найди",
    "нужно найти",
    "необходимо найти",
    "твоя задача",
    "твоя цель",
)
# Units and symbols that mark a line as content.
CONTENT_TOKENS = (
    "%", "кг", "т", "шт", "л", "меш", "вагон", "гост", "ту", "n", "p", "k", "s",
)
NOT_FOUND = "не найдено"

# Marker before the text inside a prompt.
TEXT_MARKER = "Текст для извлечения данных:"
# Key of the critic's verdict, facet names, facet parameters.
CRITIC_KEY = "найдены_ошибки"
STANDARD = "стандарт"
GRADE = "марка"

# Wording of the error messages.
SUBSTANCE_LABEL = "Вещество"
PARAMETER_LABEL = "Параметр"
PREDICTED_LABEL = "предсказано"
TRUTH_LABEL = "истина"
ABSENT_LABEL = "отсутствует"
UNIT_LABEL = ", единица: "
EXAMPLE_TEXT_LABEL = "Текст примера"
EXAMPLE_ANSWER_LABEL = "Ответ примера"
SCHEMA_HEADING = "Точная JSON-схема ожидаемого ответа:"

# Method names and their short titles.
BASELINE_METHOD = "DETAILED_INSTR_ZEROSHOT_BASELINE"
METHOD_ALIASES = {
    "DETAILED_INSTR_ZEROSHOT_BASELINE": "1.DIZB",
    "DETAILED_INSTR_ONESHOT": "2.DIO",
    "MINIMAL_INSTR_FIVESHOT": "3.MIF",
    "DETAILED_INSTR_ZEROSHOT_CD_RUS_OUTLINES": "4.DIZCRO",
    "DETAILED_INSTR_ONESHOT_CD_RUS_OUTLINES": "5.DIOCRO",
    "MINIMAL_INSTR_FIVESHOT_CD_RUS_OUTLINES": "6.MIFCRO",
    "DETAILED_INSTR_ZEROSHOT_CD_OUTLINES": "7.DIZCOP",
    "DETAILED_INSTR_ZEROSHOT_CD_RUS_GUIDANCE": "8.DIZCRG",
    "DETAILED_INSTR_ONESHOT_CD_RUS_GUIDANCE": "9.DIOCRG",
    "MINIMAL_INSTR_FIVESHOT_CD_RUS_GUIDANCE": "10.MIFCRG",
    "MA_SIMPLE_4AGENTS": "11.MS4",
    "MA_CRITIC_3AGENTS": "12.MC3",
    "MA_VALIDATION_FIX_2AGENTS_DETAILED_INSTR_ZEROSHOT_BASELINE": "13.MVF2DIZB",
}
# Descriptions of the methods.
METHOD_DESCRIPTIONS = {
    "DETAILED_INSTR_ZEROSHOT_BASELINE": "Детальный zero-shot промпт (baseline)",
    "DETAILED_INSTR_ONESHOT": "Детальный one-shot промпт",
    "MINIMAL_INSTR_FIVESHOT": "Минимальный инструктивный few-shot (5 примеров)",
    "DETAILED_INSTR_ZEROSHOT_CD_RUS_OUTLINES":
        "Детальный zero-shot промпт с constrained decoding (outlines) со схемой на русском языке",
    "DETAILED_INSTR_ONESHOT_CD_RUS_OUTLINES":
        "Детальный one-shot промпт с constrained decoding (outlines) со схемой на русском языке",
    "MINIMAL_INSTR_FIVESHOT_CD_RUS_OUTLINES":
        "Минимальный few-shot промпт с constrained decoding (outlines) со схемой на русском языке",
    "DETAILED_INSTR_ZEROSHOT_CD_OUTLINES":
        "Детальный zero-shot промпт с constrained decoding (outlines) с подачей Pydantic-схемы с ключами на английском в промпте",
    "DETAILED_INSTR_ZEROSHOT_CD_RUS_GUIDANCE":
        "Детальный zero-shot промпт с constrained decoding (guidance) со схемой на русском языке",
    "DETAILED_INSTR_ONESHOT_CD_RUS_GUIDANCE":
        "Детальный one-shot промпт с constrained decoding (guidance) со схемой на русском языке",
    "MINIMAL_INSTR_FIVESHOT_CD_RUS_GUIDANCE":
        "Минимальный few-shot промпт с constrained decoding (guidance) со схемой на русском языке",
    "MA_SIMPLE_4AGENTS": "Рабочий процесс \"Разделение обязанностей\" (4 агента)",
    "MA_CRITIC_3AGENTS": "Рабочий процесс 3 агента: генератор, критик, исправитель",
    "MA_VALIDATION_FIX_2AGENTS_DETAILED_INSTR_ZEROSHOT_BASELINE":
        "Два агента, генерация JSON → валидация Pydantic → при ошибках второй вызов LLM-исправителя по тексту, "
        "черновику и сообщениям валидации",
}
# Endings of stored names that tell the decoder.
DECODER_SUFFIXES = ("_OUTLINES", "_GUIDANCE")
# Older template names and their present ones.
TEMPLATE_ALIASES = {
    "DETAILED_INSTR_ZEROSHOT_BASELINE_OUTLINES_RUS": "DETAILED_INSTR_ZEROSHOT_CD_RUS",
    "DETAILED_INSTR_ONESHOT_OUTLINES_RUS": "DETAILED_INSTR_ONESHOT_CD_RUS",
}
# Method prefixes of runs made through a serving backend, and
# the two agent modes whose folder also names the prompt.
BACKEND_PREFIXES = ("OLLAMA_", "VLLM_")
BACKEND_TITLES = {"OLLAMA_": "Ollama", "VLLM_": "vLLM"}
MODES_WITH_PROMPT = ("validation_fix_2agents", "critic_3agents")
DEFAULT_CONTEXT = 131072
