"""Names, word lists and limits that results depend on. Fixed values throughout."""

NS = "http://example.org/geographbg#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, LABEL, COMMENT = RDF + "type", RDFS + "label", RDFS + "comment"
VALUE, UNIT = NS + "имаСтойност", NS + "имаМернаЕдиница"
QUANTITY_TYPE = NS + "КоличественаСтойност"
COUNTRY_PREDICATE, COUNTRY = NS + "държава", NS + "България"

#: Properties that point to quantity nodes.
QUANTITY_PROPERTIES = [NS + x for x in ["надморскаВисочина", "дължинаВБългария", "общаДължина", "площНаВодосборенБасейн", "имаПлощ", "имаНаселение", "имаВисочинаНаПада", "имаОбем", "имаЗалятаПлощ", "имаСреднаНадморскаВисочина", "имаМаксималнаДълбочина", "имаДължинаНаСтена", "имаВисочинаНаСтена", "имаКапацитет", "имаДебит", "имаТемпература", "имаЕстественПрираст", "имаКоефициентНаРаждаемост", "основанПрезГодина", "имаДялОтСветовниЗапаси"]]

#: Types of the schema itself; predicates that aren't told as facts.
SCHEMA_TYPES = [OWL + x for x in ["Class", "Ontology", "AnnotationProperty", "ObjectProperty", "DatatypeProperty", "SymmetricProperty", "TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty", "Thing"]] + [RDFS + "Class", RDF + "Property", RDFS + "Resource"]
SKIPPED_PREDICATES = [RDFS + x for x in ["comment", "subClassOf", "label", "domain", "range"]] + [OWL + x for x in ["sameAs", "inverseOf", "equivalentClass", "disjointWith"]]
IGNORED_SUBJECT_TYPES = [OWL + "NamedIndividual", OWL + "Thing", RDFS + "Resource"]
IGNORED_OBJECT_TYPES = [*IGNORED_SUBJECT_TYPES, OWL + "Class", RDFS + "Class"]

#: Importance of predicates by tier, 3 to 10.
IMPORTANCE = {
    3: ["находящСеВ", "извираОт", "вливаСеВ", "притокНа", "имаПриток", "найВисокВръхНа", "столица", "еСтолицаНа", "областенЦентър", "еОбластенЦентърНа", "общинскиЦентър", "еОбщинскиЦентърНа", "мястоНаВливане", "находящСеВПодножиетоНа", "находящСеВПоречиетоНа", "имаЯзовир", "еСъставящаЧастНа", "имаСъставящаЧаст"],
    4: ["намираСеНаРека", "частОтПрироденПарк", "частОтКаскада", "странаНаПритока", "свързанС", "близоДо", "захранваСеОт"],
    5: ["имаАлтернативноИме", "основанПрезГодина", "еЗавършенПрез", "имаТипСтена", "имаСтатутНаЗащитенаМестност", "обявенаСъсЗаповед", "официаленЕзик", "датаНаОбявяване", "датаНаЗавършване", "датаНаПровеждане"],
    6: ["намираСеВЗемлищетоНа", "разположенВМестност", "проведеноЗа", "обхващаПериодОтДо", "строител", "частОтИнфраструктуренОбект"],
    7: ["граничиС", "преминаваПрез", "протичаПрез", "свързва", "стопанисваСеОт", "образува", "използваСеЗа"],
    8: ["имаОписание", "имаИстория", "имаЕтимология", "имаКлимат", "имаГеология", "имаФлора", "имаФауна", "частОтИсториятаНа"],
    9: ["имаПолезноИзкопаемо", "имаТипПочва", "имаХарактеренРастителенВид", "имаХарактеренЖивотинскиВид", "принадлежиКъмКлиматичнаЗона"],
    10: ["държава"],
}

#: Types that say too little to expand by.
GENERAL_TYPES = [NS + x for x in ("Местоположение", "КоличественаСтойност", "МернаЕдиница")]
NUMBER_TYPES = [XSD + x for x in ("decimal", "integer", "float", "double")]

TYPE_WORDS = "е тип"
MISSING = "[липсва стойност]"
GENERIC_TYPES = ["Мерна Единица", "Количествена Стойност", "Клас", "Property", "Местоположение", "Воден Обект", "Релефна Форма", "Местност"]
COUNTRY_ENDING = "държава България"

#: Sections that end the useful part of a page.
SECTIONS = ["Вижте също", "Галерия", "Източници", "Външни препратки", "Литература", "Бележки"]
MARKERS = [f"== {x} ==" for x in ["Източници", "Вижте също", "Галерия", "Външни препратки", "Литература", "Бележки", "Източници и бележки"]]

#: Types whose subjects are left out of a subgraph unless they are seeds.
NOISE_TYPES = [NS + x for x in ["Село", "Музей", "КултуренОбект", "Събитие", "ЕтнографскаОбласт", "Квартал", "Хижа", "Организация", "КандидатЗаОбщинскиСъветник", "ЖивотинскиВид", "РастителенВид", "Крепост"]]
HUB_DEGREE, LINKED_PER_QUESTION, LINKED_ONLINE, DESCRIPTION_CHARS = 50, 16, 12, 300

#: Latin letters typed for Cyrillic ones, and two words that the letters alone don't mend.
LATIN, CYRILLIC = "aeocpxAEKMHOPCTXB", "аеосрхАЕКМНОРСТХВ"
CORRECTIONS = {"centralен": "централен", "socialно-икономическия": "социално-икономическия"}

#: Words of the domain score.
STOP_WORDS = ["в", "на", "са", "кои", "е", "с", "и", "или", "до", "от", "за", "под", "над", "през"]
QUANTITY_STEMS = ["колко", "висок", "дълг", "дълж", "площ", "дълбок", "обем", "населен", "дебит", "температур", "капацитет", "най-"]
AFFINITY = {"населен": "население", "висок": "височина", "височин": "височина", "дълг": "дължина", "дълж": "дължина", "площ": "площ", "дълбок": "дълбочина", "дълбочин": "дълбочина", "обем": "обем", "дебит": "дебит", "температур": "температура", "капацитет": "капацитет"}
COUNTRY_ASKED = ["държава", "българия", "къде се намира"]
COUNTRY_OFF = ["височина", "дължина", "площ", "колко е", "най-", "тип"]
PLAIN_NOUNS = ["река", "планина", "езеро", "връх"]

#: Keywords of question domains, first match from the top.
DOMAINS = {
    "world_geo": ["индия", "япония", "китай", "бразилия", "сащ", "африк", "азия", "австрал", "американ", "европ", "франция", "германия", "русия", "иран", "египет", "аржентина", "канада", "мексико", "нигерия", "конго", "амазонка", "нил", "хималаи", "алпи", "анди", "сахара", "океан", "екватор", "нафта"],
    "econ_social_geo": ["стопанство", "промишленост", "въдство", "земеделие", "отглежда", "царевица", "слънчоглед", "памук", "цвекло", "тютюн", "пшеница", "лоз", "овощ", "туризъм", "транспорт", "енергетика", "руди", "въглища", "население на българия", "демограф", "раждаемост", "смъртност", "миграц", "етнос", "религи", "град", "село", "урбаниз", "регион", "ньойски", "договор", "промишлен"],
}
#: Keywords of topics; the most hits win, the first declared on a tie.
TOPICS = {
    "relief": ["релеф", "хребет", "вър", "планин", "котловин", "низин", "плато", "рид", "проход", "седловин", "дол", "скал", "пещер"],
    "hydrography": ["река", "реки", "езер", "вод", "поречи", "басейн", "водопад", "канал", "язовир", "крайбрежи", "море", "залив", "нос"],
    "climate": ["климат", "температур", "валеж", "вятър", "борá", "бриз", "атмосфер", "озон", "циркулац", "брегова", "черноморск"],
    "soils_vegetation": ["почв", "гор", "дърв", "раститeл", "растит", "зона", "пояс", "биом", "лонгоз", "степ", "ливад"],
    "admin_settlements": ["облает", "общин", "област", "районн", "гр.", "град", "населен", "гкпп", "границ", "административн"],
    "economy_transport": ["стопанств", "отрасъл", "промишл", "земедел", "транспорт", "магистрал", "железопът", "пристанищ", "енерги", "туризъм", "селско", "животновъд", "растениевъд", "нефт", "въглищ", "металург", "химическ", "хранит", "текстил"],
    "population": ["население", "демограф", "раждаем", "смъртност", "гъстот", "урбаниз", "миграц", "естествен прираст", "застарявa"],
    "protected_areas": ["национален парк", "природен парк", "резерват", "юнеско", "защитен", "еделвайс", "биосфер"],
    "world_geography": ["континент", "световн", "регион", "африк", "азия", "европ", "америк", "азиатск", "страна", "държав", "пазарно стопанство", "продоволстве", "мегалоп"],
}
#: Marks of questions about the country.
COUNTRY_MARKS = ["българия", "балкан", "дунав", "черно море", "марица", "искър", "рила", "родоп", "стара планин", "пирин", "вит", "тунджа"]

#: Texts of the prompts.
# The words of the prompts are part of what is embedded, linked and scored ("тип" in them decides a
# penalty), so they are fixed too.
MCQ_HEAD = "Ще ти бъде даден въпрос от затворен тип с 4 опции: A, B, C и D. Отговори като използваш само буквата на верния отговор.\n\nВъпрос: "
MCQ_TAIL = "Отговор:"
NO_CONTEXT = "Няма намерен специфичен контекст."
GROUNDED_HEAD = "Използвай САМО предоставения контекст, за да отговориш на въпроса. Въпросът е от затворен тип (с варианти за отговор). Един факт от контекста може да подкрепя пряко верния вариант, ИЛИ да изключва останалите варианти (напр. при въпроси от типа „кое НЕ е вярно/не се отнася“, или при въпроси за несъответствие между двойки) — и двата случая се считат за достатъчно основание да отговориш. Отговори с '-' САМО ако контекстът е изцяло неотносим както към въпроса, така и към всички варианти за отговор.\n\nКонтекст:\n---------------------\n"
GROUNDED_MIDDLE = "\n---------------------\n\nВъпрос:\n---------------------\n"
GROUNDED_TAIL = "\n---------------------\n\nОтговор: (САМО С ГОРНИЯ КОНТЕКСТ - ако е изцяло неотносим, отговори с '-')"
