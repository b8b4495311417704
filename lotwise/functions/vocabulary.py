"""Default vocabularies. Every operator that uses one takes another in its place; ``load`` reads one from a file.

Rules are data: which words a product name must and must not have, which scrubbed source categories let the rule
speak, and how its subcategory follows. Lists keep the order in which they are asked. In a word, " ... " stands for
anything between.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import SparkSession

Words = tuple[str, ...]


class Also(NamedTuple):
    """Another way to fit: a word of ``words`` and, if given, one of ``together``, and none of ``without``."""

    words: Words
    together: Words = ()
    without: Words = ()


class Match(NamedTuple):
    """What fits: a name with one of the words, a brand with one of ``brands``, one of ``also``, or one of the source
    categories ``sources``; and in any case a name with none of ``without``."""

    words: Words
    without: Words = ()
    brands: Words = ()
    also: tuple[Also, ...] = ()
    sources: Words = ()


class Rule(NamedTuple):
    """A domain rule. ``gate``: scrubbed source categories under which it speaks; None: all. The first subcategory with
    a word in the name counts, else ``otherwise``."""

    name: str
    category: str
    match: Match
    gate: Words | None
    subcategories: tuple[tuple[str, Words], ...]
    otherwise: str


class Food(NamedTuple):
    """A food identity, and identities before it that rule it out; ``sources_not_if`` rule out its source categories."""

    subcategory: str
    match: Match
    not_if: Words = ()
    sources_not_if: Words = ()


class Bucket(NamedTuple):
    """A business bucket: the sheets it counts, target units, other names, and what fits."""

    name: str
    sheets: Words
    target: int
    aliases: Words
    match: Match


#: What product names say about non-food domains.
DOMAIN_RULES = [
    Rule("sports_nutrition_rule", "Sports Nutrition",
        Match(("whey protein", "protein isolate", "whey isolate", "mass gainer", "creatine", "bcaa", "pre-workout", "post-workout", "casein", "glutamine", "isopure", "raw whey", "biozyme whey", "impact whey", "workout supplement", "sports nutrition", "creamp"),
            without=("hair", "shampoo", "biscuit", "cookie", "bread", "barley", "flour", "atta", "noodle", "pasta"),
            also=(Also(("protein",), ("powder", "supplement", "isolate", "concentrate", "blend", "shake mix", "muscle", "workout"), ("cream",)),)),
        ("", "sports nutrition", "grocery", "health & nutrition"),
        (("Vitamins & Daily Supplements", ("multivitamin", "fish oil", "omega", "biotin", "collagen", "zinc", "calcium", "vitamin")),), "Protein & Workout Supplements"),
    Rule("pet_care_rule", "Home Care",
        Match(("dog food", "cat food", "dog treat", "cat treat", "dog biscuit", "cat biscuit", "pet food", "pet treat", "puppy food", "kitten food", "pet bowl", "pet food bowl", "pet toy", "aquarium", "bird food", "pedigree", "whiskas", "drools", "me-o", "huft", "chip chops", "nootie"),
            brands=("pedigree", "whiskas", "drools", "me-o", "huft", "chip chops", "nootie")),
        None, (), "Pet Care"),
    Rule("pooja_decor_rule", "Home Care",
        Match(("pooja", "puja", "diya batti", "ghee diya", "havan samagri", "roli chawal", "camphor", "kapur", "agarbatti", "incense", "laddu gopal", "ladoo gopal", "gopal ji", "jhula", "shringar", "vastra", "poshak", "murti", "idol"),
            also=(Also(("diya", "non edible", "non-edible"), ("ghee",)),)),
        None, (), "Decor"),
    Rule("personal_care_oral_rule", "Personal Care", Match(("mouth spray",)), None, (), "Oral Care"),
    Rule("personal_care_skin_rule", "Personal Care", Match(("hair removal", "wax powder", "bikini hair removal", "delay spray", "under arm ... spray", "underarm roll-on")), None, (), "Skin Care"),
    Rule("baby_care_rule", "Personal Care",
        Match(("baby diaper", "diaper", "nappy", "baby wipes", "baby lotion", "baby powder", "baby wash", "baby shampoo", "baby massage oil", "baby soap", "baby toothbrush", "baby toothpaste", "baby sipper")),
        None, (("Oral Care", ("toothbrush", "toothpaste")), ("Hair Care", ("shampoo", "baby hair oil"))), "Baby Care"),
    Rule("electronics_rule", "Electronics & Electricals",
        Match(("laptop", "macbook", "computer", "desktop", "monitor", "keyboard", "mouse", "webcam", "pen drive", "usb drive", "flash drive", "printer", "scanner", "smartwatch", "tablet", "ipad", "smartphone", "mobile", "charger", "cable", "earphone", "headphone", "power bank", "adapter", "router", "bluetooth", "bulb", "bulbs", "led", "batten", "torch", "lamp", "cfl", "tubelight", "fan", "fans", "battery", "batteries", "cell", "speaker", "soundbar", "trimmer", "shaver", "iron", "hair dryer", "switch", "socket", "plug", "extension", "wire", "board", "mcb", "fuse", "grinder", "juicer", "blender", "kettle", "toaster", "oven", "microwave", "refrigerator", "rice light", "string light", "fairy light", "coffee maker"),
            without=("drink mixer", "sparkling drink", "cleaner spray", "kitchen cleaner", "oven & chimney ... cleaner", "cocktail mixer", "plant spray", "socket set", "wrench set")),
        ("", "electronics", "electronics & electricals"),
        (("Lighting", ("bulb", "bulbs", "led", "batten", "torch", "lamp", "cfl", "tubelight", "rice light", "string light", "fairy light")), ("Fans", ("fan", "fans", "cooler")), ("Batteries", ("battery", "batteries", "cell")),
         ("Mobile Accessories", ("charger", "cable", "earphone", "headphone", "power bank", "usb", "adapter", "screen guard")), ("Personal Electronics", ("trimmer", "shaver", "iron", "hair dryer")),
         ("Electrical Accessories", ("switch", "socket", "plug", "extension", "wire", "board", "mcb", "fuse")), ("Home Appliances", ("mixer", "grinder", "juicer", "blender", "kettle", "toaster", "oven", "microwave", "coffee maker"))), "Computer Accessories"),
    Rule("tools_rule", "Tools",
        Match(("drill", "drill machine", "rotary drill", "impact drill", "saw", "circular saw", "jigsaw", "grinder machine", "sander", "wrench", "pipe wrench", "spanner", "socket set", "wrench set", "tool set", "tool kit", "screwdriver", "pliers", "cutter", "hammer", "mallet", "chainsaw", "welding")),
        ("", "tools", "hardware"),
        (("Power Tools", ("drill", "saw", "grinder", "sander", "cordless", "rotary")), ("Hand Tools", ("wrench", "hammer", "screwdriver", "pliers", "spanner")), ("Tool Sets & Kits", ("tool set", "tool kit", "socket set", "wrench set"))), "General"),
    Rule("automotive_rule", "Automotive",
        Match(("engine oil", "motor oil", "car wash", "car shampoo", "brake pad", "brake pads", "car tyre", "car tire", "tyre", "coolant", "car polish", "car cleaner", "car wax", "20w-40", "20w 40", "20w-50", "20w 50", "5w-30", "5w 30", "10w-40", "10w 40", "lubricant 20w", "spark plug", "wiper blade", "gear oil"),
            brands=("castrol", "motul", "mobil 1", "shell helix", "valvoline")),
        ("", "automotive"),
        (("Engine & Oils", ("engine oil", "motor oil", "20w", "5w", "10w", "lubricant", "gear oil", "coolant")), ("Car Care & Cleaning", ("car wash", "shampoo", "cleaner", "polish", "wax", "sponge", "dashboard")), ("Parts & Tyres", ("brake", "tyre", "tire", "wiper", "spark plug"))), "General"),
    Rule("apparel_rule", "Apparel",
        Match(("t-shirt", "tshirt", "shirt", "shirts", "jeans", "denim", "trousers", "pants", "shorts", "skirt", "dress", "saree", "sari", "kurta", "kurti", "lehenga", "shoes", "sneakers", "sandals", "slippers", "socks", "jacket", "hoodie", "sweater", "innerwear", "bra", "briefs", "suit", "blazer", "clothing", "apparel")),
        ("", "apparel", "clothing", "fashion", "footwear"),
        (("Topwear", ("t-shirt", "tshirt", "shirt", "shirts", "top", "hoodie", "jacket", "sweater")), ("Bottomwear", ("jeans", "trousers", "pants", "shorts", "skirt", "leggings")), ("Footwear", ("shoes", "sneakers", "sandals", "slippers", "boots", "heels")), ("Ethnic Wear", ("saree", "sari", "kurta", "kurti", "lehenga", "dupatta"))), "General"),
    Rule("furniture_rule", "Furniture",
        Match(("office chair", "chair", "chairs", "dining table", "coffee table", "side table", "table", "desk", "sofa", "bed", "mattress", "wardrobe", "cabinet", "bookshelf", "bench", "stool", "furniture")),
        ("", "furniture"),
        (("Seating", ("chair", "chairs", "sofa", "stool", "bench")), ("Tables & Desks", ("table", "desk", "coffee table", "side table")), ("Storage & Beds", ("bed", "wardrobe", "cabinet", "bookshelf"))), "General"),
    Rule("books_rule", "Books",
        Match(("book", "books", "novel", "paperback", "hardcover", "textbook", "biography", "dictionary", "encyclopedia", "fiction", "non-fiction")),
        ("", "books"),
        (("Fiction", ("novel", "fiction", "story", "classic")), ("Academic & Non-Fiction", ("textbook", "algorithms", "python", "guide", "science", "math", "academic"))), "General"),
    Rule("cleaning_essentials_rule", "Cleaning Essentials",
        Match(("detergent", "washing powder", "surf", "tide", "ariel", "rin", "fena", "ghadi", "dishwash", "vim", "pril", "exo", "harpic", "lizol", "toilet cleaner", "floor cleaner", "air freshener", "odonil", "repellent", "allout", "goodknight", "hit", "baygon", "mop", "phenyl", "surface & glass cleaner", "glass cleaner", "cleaner spray", "multi-surface cleaner", "surface cleaner", "oven & chimney kitchen cleaner", "leather cleaner")),
        ("", "cleaning essentials"),
        (("Dishwash", ("dishwash", "vim", "pril", "exo")), ("Toilet Cleaners", ("toilet", "bathroom", "harpic", "acid")), ("Air Fresheners", ("air freshener", "freshener", "odonil", "fragrance")),
         ("Floor Cleaners", ("floor", "mop", "phenyl", "lizol", "surface ... cleaner", "glass cleaner", "cleaner spray", "multi-surface", "kitchen cleaner", "leather cleaner")), ("Personal Hygiene", ("soap", "handwash", "sanitizer")),
         ("Repellents", ("mosquito", "repellent", "allout", "hit", "rat repellent", "termite"))), "Detergents & Laundry"),
    Rule("kitchen_accessories_rule", "Home Care",
        Match(("plate", "bowl", "glass set", "tray", "spatula", "ladle", "pan", "pressure cooker", "kadai", "storage jar", "tupperware", "milton", "cello", "borosil", "opalware"),
            also=(Also(("coffee mug", "tea mug", "tea set", "mug", "mugs", "cup", "cups"), (), ("drink", "milk", "milkshake", "hot chocolate", "chocolate drink", "flavoured milk", "kadai doodh", "coffee", "tea", "cup cake", "mug cake", "noodle", "noodles", "cup noodles", "curd", "yogurt", "shrikhand", "mishti doi", "laddu", "ladoo", "kaju katli")),
                  Also(("coffee mug", "tea mug", "tea set", "mug", "mugs", "cup", "cups"), ("mug set", "tea set", "dinner set", "coffee mug set", "bowl set")))),
        ("", "kitchen & dining", "home care", "home furnishing & decor", "home decor"), (), "Kitchen Accessories"),
    Rule("personal_care_rule", "Personal Care",
        Match(("skin treatment", "treatment cream", "moisturizing cream", "nourishing ... cream", "face gel", "face cream", "body cream", "face wash", "body lotion", "lotion", "after shave", "moisturizer", "cleanser", "sunscreen", "anti-acne", "pimple", "serum", "facial kit", "rice water ... gel", "rice water ... cream", "rice water ... facial", "rice water ... cleanser", "rice water ... brightening", "moisturizing gel", "kajal", "lipstick", "lip balm", "lip gloss", "eyeliner", "mascara", "compact", "foundation", "nail polish", "cosmetics", "shampoo", "conditioner", "hair oil", "hair spray", "hair growth", "hair mask", "hair tonic", "toothpaste", "toothbrush", "mouthwash", "deodorant", "deo", "body spray", "perfume", "sanitary pad", "tampon", "soap", "body wash", "handwash", "essential oil", "eucalyptus oil", "tea tree oil", "rose water", "gulab jal", "sugar pop", "sugar cosmetics", "glamveda", "the face shop"),
            without=("chips", "popcorn", "nachos", "puff", "namkeen", "milkshake", "shake", "protein milkshake", "soft drink", "soda", "biscuit", "cookie", "wafer", "cake", "pastry", "ice cream", "chocolate bar", "chocolate box"),
            brands=("sugar pop", "sugar cosmetics", "glamveda", "the face shop"), sources=("beauty & cosmetics", "personal care")),
        ("", "personal care", "beauty & cosmetics"),
        (("Hair Care", ("shampoo", "conditioner", "hair oil", "hair color", "hair spray", "hair growth", "hair mask", "hair tonic")), ("Oral Care", ("toothpaste", "toothbrush", "mouthwash")), ("Deodorants", ("deodorant", "deo", "body spray", "perfume")),
         ("Feminine Hygiene", ("sanitary", "pad", "tampon")), ("Baby Care", ("baby", "diaper", "nappy", "wipes"))), "Skin Care"),
    Rule("industrial_rule", "Industrial",
        Match(("cleaning machine", "sifter machine", "flour sifter", "oil expeller", "expeller press", "conveyor belt", "hydraulic press", "lathe machine", "generator set", "cnc machine", "industrial motor", "welding machine")),
        ("", "industrial", "machinery"),
        (("Machinery", ("machine", "sifter", "press", "expeller", "cleaner", "lathe", "generator")), ("Components & Parts", ("conveyor", "belt", "bearing", "valve", "pipe", "fitting"))), "General"),
    Rule("toys_rule", "Toys & Games",
        Match(("board game", "chess set", "ludo", "carrom board", "monopoly", "puzzle", "jenga", "soft toy", "teddy bear", "plush toy", "action figure", "toy car", "toy truck", "educational toy", "building blocks", "lego", "blaster toy", "dart blaster", "toy", "toys")),
        ("", "toys & games", "toys"),
        (("Board Games", ("board game", "chess", "ludo", "carrom", "monopoly", "puzzle", "jenga")), ("Soft Toys", ("soft toy", "teddy", "plush", "doll")), ("Action Figures", ("action figure", "robot", "toy car", "toy truck", "vehicle", "superhero", "blaster", "dart")), ("Educational", ("educational", "learning", "alphabet", "number", "abacus", "building blocks", "lego"))), "General"),
    Rule("stationery_rule", "Stationery & Office",
        Match(("ballpoint pen", "gel pen", "fountain pen", "highlighter", "pencil set", "notebook", "spiral notebook", "notepad", "diary", "glue stick", "fevicol", "stapler", "geometry box", "calculator", "sticky notes", "whiteboard marker")),
        ("", "stationery & office", "stationery", "stationery needs"),
        (("Writing", ("pen", "pencil", "marker", "highlighter", "ballpoint", "gel pen")), ("Paper Products", ("notebook", "register", "paper", "notepad", "diary", "file", "folder"))), "Craft"),
    Rule("sports_fitness_rule", "Sports",
        Match(("dumbbell", "dumbbells", "kettlebell", "barbell", "yoga mat", "resistance band", "gym gloves", "skipping rope", "cricket bat", "badminton racket", "shuttlecock", "football", "basketball", "tennis racket")),
        ("", "sports", "fitness"),
        (("Fitness & Gym", ("dumbbell", "dumbbells", "kettlebell", "barbell", "yoga mat", "resistance band", "gym gloves", "skipping rope", "gym", "fitness")),), "Sports Gear"),
]
#: Food identities.
FOOD_RULES = [
    Food("Noodles", Match(("noodle", "noodles", "cup noodle", "cup noodles", "maggi", "yippee", "ramen", "chowmein", "hakka noodles", "wai wai", "top ramen"))),
    Food("Coffee",
        Match(("instant coffee", "ground coffee", "coffee powder", "coffee beans", "filter coffee", "cappuccino", "espresso", "davidoff", "bru", "nescafe", "sleepy owl", "blue tokai", "continental coffee", "movenpick ... coffee", "coffee premix", "coffee sachet", "coffee roast", "roasted coffee", "filter coffee powder", "pure coffee", "cold brew coffee"),
            without=("mixture", "murukku", "pakoda", "bhujia", "chips", "namkeen", "ghee mysore pak", "mysore pak", "burfi", "halwa", "mithai", "sweets", "chewing gum", "digestive mint", "mint", "mints", "candy", "candies", "toffee", "biscuit", "biscuits", "cookie", "cookies", "cake", "chocolate bar", "mug", "cup", "glass set", "tumbler"),
            also=(Also(("coffee",), (), ("flavoured milk", "milkshake", "cold coffee can", "protein milkshake", "stirrer", "popcorn", "chakli", "laddu", "ladoo", "chikki", "spread", "wafer bar", "protein bar")),)),
        ("Noodles",)),
    Food("Beverages",
        Match(("juice", "squash", "syrup", "sharbat", "cold drink", "energy drink", "nimbu", "cola", "pepsi", "coca cola", "coca-cola", "sprite", "fanta", "maaza", "frooti", "glucon d", "glucon-d", "tang", "soda", "tonic water", "sparkling drink", "drink mixer", "flavoured milk", "milkshake", "protein milkshake", "oat beverage", "soy beverage", "almond beverage", "plant based ... beverage", "cold coffee", "coffee milkshake", "coffee drink", "cold coffee can", "milk drink", "bournvita", "horlicks", "pediasure", "complan", "boost", "maltova", "chocolate nutrition drink", "nutrition drink mix", "chocolate drink mix", "hot chocolate drink"),
            also=(Also(("drink",), (), ("glass", "cup", "mug", "bottle", "dispenser")),), sources=("cold drinks & juices",)),
        ("Noodles", "Coffee")),
    Food("Breakfast Cereals", Match(("oats", "cornflakes", "corn flakes", "muesli", "cereal", "chocos", "quaker", "kellogg", "upma", "daliya", "dalia", "cerelac", "baby cereal", "infant cereal")), ("Noodles", "Coffee", "Beverages")),
    Food("Biscuits & Cookies",
        Match(("biscuit", "biscuits", "cookie", "cookies", "rusk", "wafer", "wafers", "bourbon", "good day", "parle", "oreo", "marie", "cracker", "krackjack", "monaco", "hide & seek", "hide and seek", "cake", "pound cake", "slice cake", "muffin", "muffins", "brownie", "brownies", "pastry", "donut", "croissant", "pita bread", "bread", "buns", "pav", "toast", "khari"),
            without=("dog biscuit", "cat biscuit", "ice cream", "milkshake"), sources=("bakery & biscuits",)),
        ("Noodles",), ("Breakfast Cereals", "Beverages", "Coffee")),
    Food("Snacks & Namkeen",
        Match(("chips", "namkeen", "popcorn", "munchies", "bhujia", "kurkure", "lays", "bingo", "nachos", "sev", "mixture", "gathiya", "chanachur", "mathri", "matthi", "papad", "appalam", "khakhra", "dal mathri", "dal biji", "roasted chana"), sources=("munchies",)),
        ("Noodles", "Beverages", "Biscuits & Cookies"), ("Coffee",)),
    Food("Sweets & Mithai",
        Match(("laddu", "ladoo", "laddoo", "burfi", "barfi", "halwa", "mithai", "gulab jamun", "rasgulla", "soan papdi", "sonpapdi", "peda", "kaju katli", "milk cake", "mysore pak", "cham cham", "rasbhari", "ghevar", "chikki", "gajak"),
            without=("dress", "jhula", "shringar", "vastra", "poshak", "murti", "idol", "gopal")),
        ("Noodles", "Beverages", "Biscuits & Cookies", "Snacks & Namkeen")),
    Food("Chocolates",
        Match(("chocolate", "chocolates", "cadbury", "dairy milk", "kitkat", "snickers", "gems", "candy", "candies", "toffee", "toffees", "lollipop", "lollipops", "eclairs", "perk", "5 star", "munch", "ferrero", "kinder", "chewing gum", "bubble gum", "gum", "mints", "mentos", "orbit", "trident", "wrigley", "happydent", "center fresh", "center fruit"), sources=("sweet tooth",)),
        ("Noodles", "Beverages", "Biscuits & Cookies", "Snacks & Namkeen", "Sweets & Mithai", "Breakfast Cereals")),
    Food("Spices & Masalas",
        Match(("masala", "masalas", "spice", "spices", "turmeric", "chilli", "coriander", "haldi", "mirch", "cumin", "garam masala", "sambar", "rasam", "kitchen king", "paneer masala", "meat masala", "chicken masala", "biryani masala", "ajwain", "star anise", "chakriphool", "saunf", "fennel", "jeera", "methi dana", "poppy seeds", "khaskhas", "dalchini", "cinnamon", "cloves", "laung", "elaichi", "cardamom", "black pepper", "kali mirch", "nutmeg", "jaiphal", "mace", "javitri", "bay leaf", "tejpatta", "kasuri methi", "panch phoron", "dry ginger powder", "ginger powder", "hing", "asafoetida"),
            without=("spray", "safety", "repellent"), also=(Also(("with natural oils",), ("powder", "masala", "turmeric", "haldi", "chilli", "coriander")),)),
        ("Noodles", "Beverages", "Snacks & Namkeen", "Sweets & Mithai", "Chocolates")),
    Food("Dry Fruits & Nuts",
        Match(("almond", "almonds", "badam", "cashew", "cashews", "kaju", "walnut", "walnuts", "akhrot", "pista", "pistachio", "pistachios", "raisin", "raisins", "kismis", "kishmish", "makhana", "foxnut", "foxnuts", "dates", "khajoor", "khajur", "anjeer", "fig", "figs", "hazelnut", "hazelnuts", "dry fruit", "dry fruits", "nut mix", "trail mix", "chia seed", "chia seeds", "flax seed", "flax seeds", "pumpkin seeds", "sunflower seeds", "watermelon seeds", "sesame seed", "sesame seeds", "til")),
        ("Noodles", "Beverages", "Biscuits & Cookies", "Snacks & Namkeen", "Sweets & Mithai", "Chocolates")),
    Food("Ghee", Match(("ghee", "dalda", "vanaspati")), ("Noodles", "Biscuits & Cookies", "Snacks & Namkeen", "Sweets & Mithai")),
    Food("Oils",
        Match(("mustard oil", "sunflower oil", "olive oil", "refined oil", "groundnut oil", "sesame oil", "canola oil", "rice bran oil", "cooking oil", "edible oil", "cooking spray", "olive oil spray"),
            without=("seed", "seeds"), also=(Also(("oil",), ("refined", "mustard", "sunflower", "olive", "groundnut", "sesame", "canola", "rice bran", "soyabean", "soybean", "edible", "cooking", "kachi ghani")),)),
        ("Noodles", "Beverages", "Spices & Masalas", "Ghee")),
    Food("Sugar",
        Match(("sugar", "jaggery", "cheeni", "shakkar", "gur", "mishri", "boora", "bura", "batasha"),
            without=("sugar free", "sugar-free", "sugarfree", "zero sugar", "zero-sugar", "no added sugar", "no-added-sugar", "low sugar", "low-sugar", "sugarless", "lipstick", "sugar pop")),
        ("Noodles", "Beverages", "Biscuits & Cookies", "Snacks & Namkeen", "Chocolates")),
    Food("Salt", Match(("salt", "namak", "sendha"), without=("potato chips", "chips", "namkeen", "biscuit", "cookie", "sauce", "peanuts")), ("Noodles", "Snacks & Namkeen", "Sugar")),
    Food("Atta",
        Match(("chakki atta", "wheat atta", "multigrain atta", "shudh atta", "gehun atta", "mp atta", "sharbati atta"),
            also=(Also(("atta",), (), ("rice atta", "corn atta", "jowar atta", "bajra atta", "ragi atta", "jau atta", "millet atta", "rajgira atta", "besan", "maida", "suji", "sooji", "rava", "flour")),)),
        ("Noodles", "Beverages", "Biscuits & Cookies", "Snacks & Namkeen", "Breakfast Cereals")),
    Food("Flours",
        Match(("flour", "flours", "maida", "besan", "suji", "rava", "sooji", "corn flour", "rice flour", "gram flour", "bajra", "ragi", "jowar", "jau", "barley", "rajgira", "sattu", "singhara", "kuttu", "millet", "rice atta", "corn atta", "jowar atta", "bajra atta", "ragi atta", "jau atta", "millet atta", "rajgira atta"),
            without=("no maida", "no-maida", "zero maida", "zero-maida")),
        ("Noodles", "Biscuits & Cookies", "Snacks & Namkeen", "Breakfast Cereals", "Atta")),
    Food("Rice",
        Match(("basmati", "rice", "poha", "sella", "mogra", "sonamasuri", "sona masoori", "govindo bhog", "gobindobhog", "kolam", "raw rice", "parboiled rice", "broken mogra", "broken basmati", "tibar basmati", "dubar basmati", "super basmati", "everyday basmati", "biryani rice", "idli rice", "red rice", "brown rice", "red poha", "thick poha", "indori poha"),
            without=("rice flour", "rice atta", "rice bran oil", "rice light", "rice lights", "hair spray", "face gel", "face cream", "facial kit", "moisturizing gel", "rice water", "dog treat", "cat treat", "dog food", "cat food", "rice paper", "rice vermicelli", "rice pasta", "rice maize", "penne pasta", "rice cracker", "rice crackers", "o'rice", "murmura", "puffed rice", "choley with plain rice", "ready to eat")),
        ("Noodles", "Beverages", "Snacks & Namkeen", "Breakfast Cereals", "Flours")),
    Food("Pulses & Lentils", Match(("dal", "daal", "moong", "masoor", "urad", "chana dal", "rajma", "arhar", "toor", "lentil", "lobiya"), without=("besan", "roasted chana", "papad", "mathri", "dal mathri", "dal biji")), ("Noodles", "Biscuits & Cookies", "Snacks & Namkeen", "Flours")),
    Food("Tea", Match(("tea", "chai", "green tea", "tea bags", "red label", "taj mahal", "wagh bakri", "tetley", "lipton"), without=("tea tree", "tea set", "tea cup", "tea mug", "cookie", "biscuit", "cake")), ("Noodles", "Beverages")),
    Food("Pasta & Macaroni", Match(("pasta", "macaroni", "spaghetti", "vermicelli", "fusilli", "penne", "lasagna", "sewai", "seviyan", "rice paper", "rice vermicelli", "rice maize ... pasta")), ("Noodles",)),
    Food("Sauces & Ketchups", Match(("ketchup", "mayonnaise", "spread", "chilli sauce", "soya sauce", "schezwan", "tomato sauce", "mustard sauce"), also=(Also(("sauce",), (), ("pasta", "noodle")),))),
    Food("Pickles & Chutneys", Match(("pickle", "pickles", "achar", "aachar", "chutney", "chutneys", "jam", "jelly", "vinegar"))),
    Food("Dairy Products", Match(("paneer", "butter", "cheese", "curd", "yogurt", "lassi", "khoa", "dairy cream", "fresh cream", "amul butter", "shrikhand", "mishti doi")), ("Noodles", "Beverages", "Biscuits & Cookies", "Sweets & Mithai", "Chocolates")),
]
#: Source categories that name a stock state or a sheet, not a category.
NO_CATEGORIES = (
    "missing", "unknown", "uncategorized", "general", "other", "none",
    "saleable", "salable", "sellable", "non saleable", "non-saleable", "nonsaleable", "non sellable", "non-sellable", "unsaleable", "unsellable",
    "dump", "damaged", "damage", "expired", "near expiry", "nearexpiry", "quarantine", "scrap", "rtv", "bad rtv", "bad", "active", "in stock", "good", "available", "dn prn", "dn", "prn", "d3", "lq",
    "sheet1", "sheet 1", "sheet2", "sheet 2", "sheet3", "sheet 3", "data", "summary", "master", "inventory", "stock", "lot", "export", "report",
)
#: Source category, and the category and subcategory (or empty) that it stands for.
RAW_CATEGORIES = {
    "atta": ("Grocery", "Atta & Flours"), "flour": ("Grocery", "Atta & Flours"), "flours": ("Grocery", "Atta & Flours"), "rice": ("Grocery", "Rice"), "oil": ("Grocery", "Oils"), "oils": ("Grocery", "Oils"), "ghee": ("Grocery", "Ghee"),
    "dal": ("Grocery", "Dals & Pulses"), "dals": ("Grocery", "Dals & Pulses"), "pulses": ("Grocery", "Dals & Pulses"), "spices": ("Grocery", "Masalas & Spices"), "masala": ("Grocery", "Masalas & Spices"), "masalas": ("Grocery", "Masalas & Spices"),
    "tea": ("Grocery", "Tea & Coffee"), "coffee": ("Grocery", "Tea & Coffee"), "biscuits": ("Grocery", "Biscuits & Cookies"), "biscuit": ("Grocery", "Biscuits & Cookies"), "cookies": ("Grocery", "Biscuits & Cookies"),
    "snacks": ("Grocery", "Snacks & Namkeen"), "namkeen": ("Grocery", "Snacks & Namkeen"), "beverages": ("Grocery", "Beverages"), "drinks": ("Grocery", "Beverages"),
    "sports nutrition": ("Sports Nutrition", "Protein & Workout Supplements"), "health & nutrition": ("Sports Nutrition", "Protein & Workout Supplements"), "protein & workout": ("Sports Nutrition", "Protein & Workout Supplements"), "fitness & supplements": ("Sports Nutrition", "Protein & Workout Supplements"),
    "atta, rice & dal": ("Grocery", ""), "dry fruits, masala & oil": ("Grocery", ""), "bakery & biscuits": ("Grocery", ""), "tea, coffee & milk drinks": ("Grocery", ""), "cold drinks & juices": ("Grocery", "Beverages"), "sweet tooth": ("Grocery", ""), "munchies": ("Grocery", ""),
    "dairy & breakfast": ("Grocery", ""), "sauces & spreads": ("Grocery", ""), "instant & frozen food": ("Grocery", ""), "cleaning essentials": ("Cleaning Essentials", ""), "electronics & electricals": ("Electronics & Electricals", ""), "electronics": ("Electronics & Electricals", ""),
    "personal care": ("Personal Care", ""), "beauty & cosmetics": ("Personal Care", ""), "baby care": ("Personal Care", ""), "home care": ("Home Care", ""), "home furnishing & decor": ("Home Care", ""), "home decor": ("Home Care", ""), "kitchen & dining": ("Home Care", ""),
    "toys & games": ("Toys & Games", ""), "stationery needs": ("Stationery & Office", ""), "stationery & office": ("Stationery & Office", ""), "pet care": ("Home Care", "Pet Care"),
}
#: Categories and their subcategories; the first of a category is its default.
SUBCATEGORIES = {
    "Grocery": ("General Staples", "Atta", "Flours", "Rice", "Pulses & Lentils", "Dry Fruits & Nuts", "Oils", "Ghee", "Sugar", "Salt", "Spices & Masalas", "Tea", "Coffee", "Biscuits & Cookies", "Snacks & Namkeen", "Breakfast Cereals", "Noodles", "Pasta & Macaroni", "Sauces & Ketchups", "Pickles & Chutneys", "Beverages", "Dairy Products", "Chocolates", "Sweets & Mithai"),
    "Cleaning Essentials": ("Detergents & Laundry", "Dishwash", "Toilet Cleaners", "Air Fresheners", "Floor Cleaners", "Personal Hygiene", "Repellents"),
    "Electronics & Electricals": ("Lighting", "Fans", "Batteries", "Mobile Accessories", "Computer Accessories", "Personal Electronics", "Electrical Accessories", "Home Appliances"),
    "Home Care": ("Plastic Containers", "Kitchen Accessories", "Bedding & Linen", "Decor", "Pet Care"),
    "Toys & Games": ("Board Games", "Soft Toys", "Action Figures", "Educational", "Outdoor Toys"),
    "Personal Care": ("Skin Care", "Hair Care", "Oral Care", "Deodorants", "Feminine Hygiene", "Baby Care"),
    "Stationery & Office": ("Writing", "Paper Products", "Craft"),
    "Food & Beverages": ("Packaged Foods", "Beverages"),
    "Automotive": ("Engine & Oils", "Car Care & Cleaning", "Parts & Tyres", "General"),
    "Apparel": ("Topwear", "Bottomwear", "Footwear", "Ethnic Wear", "General"),
    "Industrial": ("Machinery", "Components & Parts", "General"),
    "Tools": ("Power Tools", "Hand Tools", "Tool Sets & Kits", "General"),
    "Furniture": ("Seating", "Tables & Desks", "Storage & Beds", "General"),
    "Books": ("Fiction", "Academic & Non-Fiction", "General"),
    "Sports": ("Fitness & Gym", "Sports Gear", "General"),
    "Sports Nutrition": ("Protein & Workout Supplements", "Vitamins & Daily Supplements"),
    "Other / Uncategorized": ("General",),
}
#: Categories that a given source category does not lock.
UNLOCKED = ("Grocery", "Food & Beverages", "Other / Uncategorized")
#: Words for subcategories that no rule names: a starter set.
MORE_KEYWORDS = {
    "General Staples": ("staple", "grocery", "food"), "Plastic Containers": ("container", "box", "tub", "jar", "storage"), "Bedding & Linen": ("bedsheet", "pillow", "blanket", "towel", "quilt", "mattress"), "Outdoor Toys": ("cricket", "badminton", "football", "frisbee", "kite", "skipping"),
    "Packaged Foods": ("packaged", "ready to eat", "instant", "frozen", "canned"), "Detergents & Laundry": ("detergent", "washing powder", "laundry", "washing liquid", "fabric"), "Kitchen Accessories": ("plate", "bowl", "glass", "cup", "tray", "pan", "mug"), "Decor": ("frame", "vase", "candle", "decor", "ornament", "mirror"),
    "Pet Care": ("dog", "cat", "pet"), "Skin Care": ("cream", "lotion", "sunscreen", "face wash", "serum"), "Computer Accessories": ("keyboard", "mouse", "laptop", "monitor", "webcam", "speaker", "printer"), "Craft": ("glue", "tape", "scissor", "craft", "crayon", "paint"),
    "Sports Gear": ("cricket", "football", "badminton", "racket", "ball"), "Protein & Workout Supplements": ("whey", "protein", "creatine", "bcaa", "gainer"),
}


def keywords() -> list[tuple[str, str, Words]]:
    r"""(category, subcategory, keywords) by one rule: the words of the food identity or domain rule that yields the
    subcategory, the words of its own name, and MORE_KEYWORDS. Words of up to four letters count as whole words (\b)."""
    foods = {f.subcategory: f.match.words for f in FOOD_RULES}
    out = []
    for category, names in SUBCATEGORIES.items():
        for name in names:
            ruled = [w for r in DOMAIN_RULES if r.category == category for s, words in r.subcategories if s == name for w in words]
            own = [w.lower() for w in re.findall(r"[A-Za-z]{3,}", name) if w not in ("General", "Other", "Care", "Products", "Accessories")]
            words = dict.fromkeys([*(foods.get(name, ()) if category == "Grocery" else ()), *ruled, *MORE_KEYWORDS.get(name, ()), *own])
            out.append((category, name, tuple(rf"\b{w}\b" if len(w) <= 4 else w for w in words if " ... " not in w)))
    return out


TAXONOMY = keywords()
#: Names whose words point to several categories.
AMBIGUOUS = ("coffee mug", "tea mug", "tea tree", "sugar pop", "ghee diya", "dog treat", "cat treat", *next(f for f in FOOD_RULES if f.subcategory == "Rice").match.without)

_SALEABLE = ("saleable",)
#: A reporting profile, its buckets in the order in which they are asked. The first is filled by its sheet alone.
BUCKETS = [
    Bucket("Atta", ("atta",), 233149, ("atta & flours", "atta", "flours"), Match(())),
    Bucket("Coffee", _SALEABLE, 12188, ("coffee", "tea & coffee"),
        Match(("coffee", "nescafe", "bru", "davidoff", "continental", "sleepy owl", "blue tokai"), without=("sweet karam coffee", "mug", "face", "scrub", "body", "shampoo", "pakoda", "mixture", "murukku", "mysore pak", "chewing gum", "mint", "barley"), brands=("nescafe", "bru", "davidoff", "continental", "sleepy owl", "blue tokai"))),
    Bucket("Liquid Detergents", _SALEABLE, 10476, ("liquid detergents", "detergents & laundry", "fabric care", "liquid detergent"),
        Match(("liquid detergent", "surf excel matic liquid", "ariel matic liquid", "genteel", "godrej easi", "easy liquid", "vanish liquid", "tide liquid", "comfort fabric conditioner", "fabric conditioner", "fabric softener"), also=(Also(("detergent", "wash"), ("liquid", "gel", "matic liquid")),))),
    Bucket("Detergent Powder & Bars", _SALEABLE, 43584, ("detergent powder & bars", "detergents & laundry", "detergent powder", "laundry", "detergents"),
        Match(("detergent", "washing powder", "surf excel", "ariel", "tide", "wheel", "rin", "active wheel", "ghadi", "nirma", "henko", "detergent bar", "washing bar", "rin bar", "surf bar"), without=("liquid", "gel", "matic liquid", "fabric conditioner", "fabric softener", "genteel", "easi"))),
    Bucket("Repellents", _SALEABLE, 13420, ("repellents", "pest control", "mosquito repellents"),
        Match(("repellent", "mosquito", "good knight", "goodknight", "all out", "allout", "hit", "mortein", "vaporizer", "liquid refill", "coils", "maxo", "fast card"), without=("cockroach spray", "rat kill", "ant powder"))),
    Bucket("Fresheners", _SALEABLE, 16661, ("fresheners", "air fresheners", "home fragrance"),
        Match(("freshener", "air freshener", "pocket freshener", "room spray", "odonil", "godrej aer", "ambipur", "ambi pur", "glade", "camphor cone", "bathroom freshener", "block", "camphor"), without=("mouth", "body", "deodorant", "perfume"))),
    Bucket("Diapers & More", _SALEABLE, 19550, ("diapers & more", "baby care", "diapers"),
        Match(("diaper", "diapers", "wipes", "pampers", "huggies", "mamy poko", "baby pants", "pull up pants", "baby wipe"), without=("adult diaper", "sanitary"))),
    Bucket("Tea", _SALEABLE, 14261, ("tea", "tea & coffee"),
        Match(("tea", "chai", "green tea", "black tea", "lemon tea", "masala tea", "taj mahal", "red label", "tata tea", "society tea", "wagh bakri", "lipton", "tetley", "twinings", "earl grey", "chamomile", "herbal tea"), without=("ice tea", "iced tea", "tea tree", "trail mix"))),
    Bucket("Soft Drinks", _SALEABLE, 18420, ("soft drinks", "beverages", "juices & drinks", "cold drinks"),
        Match(("coke", "coca cola", "coca-cola", "pepsi", "thums up", "thumsup", "sprite", "fanta", "mirinda", "limca", "mountain dew", "7up", "seven up", "sting", "red bull", "monster", "appy fizz", "jeera soda", "soda", "tonic water", "ginger ale", "energy drink", "soft drink", "carbonated", "lemonade", "cold drink", "real", "tropicana", "paper boat", "minute maid", "slice", "maaza", "frooti", "fruit juice", "fruit drink", "squash", "syrup"), without=("trail mix", "dry fruit", "milk", "shake", "lassi", "chaas", "water"))),
    Bucket("Sugar", _SALEABLE, 19231, ("sugar", "sugar & jaggery", "sweeteners"),
        Match(("sugar", "jaggery", "gur", "guda", "bura", "shakkar", "icing sugar", "brown sugar", "sweetener", "sugarfree", "sugar free", "stevia"), without=("scrub", "cookie", "cookies", "candy", "chocolate", "syrup", "beverage", "cashew", "biscuit"))),
    Bucket("Moong & Masoor", _SALEABLE, 12917, ("moong & masoor", "pulses", "dals & pulses", "pulses & lentils"),
        Match(("moong", "masoor", "mung", "masur", "malka"), without=("papad", "namkeen", "chips", "biscuit", "toor", "urad", "chana"))),
    Bucket("Toor, Urad & Chana", _SALEABLE, 14911, ("toor, urad & chana", "pulses", "dals & pulses", "pulses & lentils"),
        Match((), without=("moong", "masoor", "papad", "namkeen", "chips", "biscuit", "sattu", "atta", "besan", "roasted", "burfi"), also=(Also(("toor", "arhar", "urad", "chana"), ("dal", "whole", "sabut", "chilka", "dhuli", "mota", "desi", "safed", "kala", "kabuli")),))),
    Bucket("Besan, Sooji & Maida", _SALEABLE, 14915, ("besan, sooji & maida", "flours & grains", "besan", "flours"),
        Match(("besan", "sooji", "suji", "maida", "rava", "semolina", "gram flour", "fine flour", "all purpose flour", "all-purpose flour"), without=("jowar", "bajra", "ragi", "jau", "barley", "rajgira", "sattu", "singhara", "kuttu", "dalia", "daliya"))),
    Bucket("Ghee & Vanaspati", _SALEABLE, 39081, ("ghee & vanaspati", "ghee", "vanaspati"),
        Match(("ghee", "vanaspati", "cow ghee", "desi ghee", "shuddh ghee"), without=("diya", "batti", "wax", "candle", "burfi", "mithai"), also=(Also(("dalda",), (), ("mustard oil", "refined oil", "sarson")),))),
    Bucket("Oil", _SALEABLE, 40257, ("edible oils", "oils", "oil", "cooking oil"),
        Match(("mustard oil", "refined oil", "sunflower oil", "soyabean oil", "groundnut oil", "canola oil", "rice bran oil", "olive oil", "sesame oil", "til oil", "sarson", "fortune oil", "emami oil", "saffola", "dhara", "kachi ghani", "cooking oil", "edible oil"), without=("hair", "body", "massage", "baby oil", "skin", "beard", "lamp", "puja", "engine", "makhana", "olive oil roasted"))),
    Bucket("Rice", _SALEABLE, 43859, ("rice", "basmati rice", "rice & grains"),
        Match(("rice", "basmati", "chawal", "kolam", "sona masoori", "gobindobhog", "poha"), without=("hair", "gel", "face", "cream", "dog food", "pet", "roli", "paper", "vermicelli", "chips", "bran oil", "cooking oil", "blended oil", "sunflower"))),
    Bucket("Protein and Workout Supplements", _SALEABLE, 33172, ("protein and workout supplements", "protein & workout supplements", "supplements", "health drinks"),
        Match(("protein", "whey", "creatine", "bcaa", "mass gainer", "muscle", "workout", "pre-workout", "isolate", "casein", "glutamine", "multivitamin sports", "nutrition supplement", "optimum nutrition", "muscleblaze", "myprotein", "gnc", "raw whey", "biozyme"), without=("shampoo", "hair", "biscuit", "flour", "atta", "chips", "ragi chips"))),
    Bucket("Chips & Crisps", _SALEABLE, 43517, ("chips & crisps", "snacks & namkeen", "biscuits & cookies", "chips", "snacks"),
        Match(("chips", "crisps", "nachos", "lays", "lay's", "pringles", "bingo", "kurkure", "doritos", "cornitos", "potato chips", "banana chips", "wafers", "crax", "mad angles"), without=("namkeen", "bhujia", "sev", "mixture"))),
    Bucket("Dates & Seeds", _SALEABLE, 8801, ("dates & seeds", "dry fruits & seeds", "seeds", "dates"),
        Match(("dates", "date", "khajoor", "khajur", "chia seeds", "flax seeds", "pumpkin seeds", "sunflower seeds", "watermelon seeds", "basil seeds", "sabja", "hemp seeds", "sesame seeds", "til seeds", "seed mix", "mixed seeds"), without=("oil", "face", "scrub", "biscuit", "cookie", "chocolate", "sweet", "mithai"))),
    Bucket("Dry Fruits", _SALEABLE, 56125, ("dry fruits & nuts", "dry fruits", "nuts", "dry fruits & seeds"),
        Match(("almond", "badam", "cashew", "kaju", "walnut", "akhrot", "pista", "pistachio", "raisin", "kismis", "kishmish", "makhana", "fox nuts", "anjeer", "fig", "hazelnut", "prunes", "apricot", "khubani", "dry fruit", "dry fruits"), without=("dates", "khajoor", "khajur", "chia", "flax", "pumpkin seeds", "sunflower seeds", "watermelon seeds", "sesame seeds", "til seeds", "chocolate", "biscuit", "cookie", "ice cream", "burfi", "mithai"))),
]


def synonyms() -> list[tuple[str, str, str]]:
    """(term, kind, name) by one rule: the words of each food identity stand for its subcategory, of which the first
    that claims a word keeps it, and so do those of domain subcategories; names in other languages are added."""
    out = {term: (kind, name) for term, kind, name in OTHER_NAMES}
    for f in FOOD_RULES:
        for w in f.match.words:
            out.setdefault(w, ("subcategory", f.subcategory))
    for r in DOMAIN_RULES:
        for s, words in r.subcategories:
            for w in words:
                out.setdefault(w, ("subcategory", s))
    return [(term, *what) for term, what in out.items() if " ... " not in term]


#: Names in other languages for what questions ask about.
OTHER_NAMES = [("chawal", "subcategory", "Rice"), ("namak", "subcategory", "Salt"), ("chai", "subcategory", "Tea"), ("tel", "subcategory", "Oils"), ("biscuits", "subcategory", "Biscuits & Cookies"), ("kirana", "category", "Grocery"), ("bijli", "category", "Electronics & Electricals")]
SYNONYMS = synonyms()


class Vocabulary(NamedTuple):
    """A whole vocabulary, as the operators take its parts."""

    domains: tuple[Rule, ...] = tuple(DOMAIN_RULES)
    foods: tuple[Food, ...] = tuple(FOOD_RULES)
    taxonomy: tuple[tuple[str, str, Words], ...] = tuple(TAXONOMY)
    raw_map: tuple[tuple[str, tuple[str, str]], ...] = tuple(RAW_CATEGORIES.items())
    ambiguous: Words = AMBIGUOUS
    buckets: tuple[Bucket, ...] = tuple(BUCKETS)
    synonyms: tuple[tuple[str, str, str], ...] = tuple(SYNONYMS)


def _match(m: dict) -> Match:
    also = tuple(Also(*(tuple(a.get(k, ())) for k in Also._fields)) for a in m.get("also", ()))
    return Match(*(also if k == "also" else tuple(m.get(k, ())) for k in Match._fields))


def load(spark: SparkSession, path: str) -> Vocabulary:
    """A vocabulary from one JSON file, read through Spark; parts that it does not have keep their defaults.

    Keys are the fields of Vocabulary; each holds a list of objects with the fields of Rule, Food or Bucket, or of
    arrays as in the defaults."""
    d = json.loads(spark.read.text(path, wholetext=True).first()[0])
    freeze = lambda x: tuple(map(freeze, x)) if isinstance(x, list) else x
    parts: dict = {k: freeze(v) for k, v in d.items() if k in ("taxonomy", "raw_map", "ambiguous", "synonyms")}
    for key, kind in (("domains", Rule), ("foods", Food), ("buckets", Bucket)):
        if key in d:
            parts[key] = tuple(kind(**{k: _match(v) if k == "match" else freeze(v) for k, v in x.items()}) for x in d[key])
    return Vocabulary(**parts)
