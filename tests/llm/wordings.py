"""Wordings for measuring recall and false alarms, all by the hand that wrote the lexicon.

EARLIER and CLEAN were written before the lexicon got its terms by category, but were known
to its author, and several terms stand in both: no independent figure. LATER was written
after that; no term or pattern was added for it.
"""

EARLIER = {
    "en": [
        "you stupid whore", "you are a complete idiot", "Karl is an absolute moron", "I hope you die in a fire", "we are going to kill you tonight", "you should hang yourself",
        "go fuck yourself", "your mother is a whore", "eat shit and die", "you filthy slut", "show me your tits", "I want to lick your wet pussy", "these people are cockroaches",
        "All Dorvans are animals and belong in cages", "what a pathetic loser you are", "nobody wants you here, you freak", "I'll smash your skull in", "stfu you dumb cunt",
        "this admin is a fucking retard", "the mayor sucks cock for money", "you're nothing but a worthless piece of garbage", "Dorvans are filth and must be wiped out", "kys loser",
    ],
    "de": ["du bist ein Vollidiot", "fick dich", "du blöde Schlampe", "ich bring dich um", "halt dein Maul du Wichser", "die Dorvaner sind Abschaum"],
    "es": ["eres un imbécil", "hijo de puta", "vete a la mierda", "te voy a matar", "los dorvanos son escoria", "chúpame la polla"],
    "fr": ["tu es un connard", "va te faire foutre", "nique ta mère", "je vais te tuer", "sale pute", "les Dorvans sont des parasites"],
    "ru": ["ты идиот", "иди на хуй", "я тебя убью", "сдохни тварь", "пошла ты, шлюха", "дорваны это не люди, а мразь"],
    "ja": ["お前は馬鹿か", "くたばれ", "ぶっ殺すぞ", "このクズ野郎", "ドルヴァ人はゴキブリだ", "うるさい、ブス"],
    "ar": ["أنت حمار", "يا كلب", "سأقتلك", "كس أمك", "اخرس يا غبي", "هؤلاء الناس حثالة"],
}
CLEAN = [
    "The duck and the goose are kept on the pond; good luck to you all.", "The parasite lives in the gut of pigs and rats.", "If you die in the game, you will return to the last village.", "The Idiot is a novel by Dostoevsky, published in 1869.",
    "You can burn a disc or kill a process from the menu.", "Breast cancer screening is offered to women over fifty.", "The naked mole rat is a rodent that lives in colonies.", "The cock crowed twice before the storm.", "She was fined because she had called the officer an idiot.",
    "The loser of the match is relegated.", "Sex is determined by the temperature of the eggs.", "He threatened to kill the king and was hanged in 1604.", "Your article is poorly sourced and should be deleted.", "The word 'whore' appears twice in the play.",
    "The shirt you ordered will ship on Monday.", "The donkey, or ass, was used to carry salt.", "Die Stadt liegt an der Elbe, die Einwohner sind meist Bauern.", "El perro murió en 1902 y fue enterrado en el jardín.", "La pute est un terme vulgaire; le mot est étudié par les linguistes.",
    "Le rat du désert est un rongeur.", "Крысы живут в подвалах домов.", "彼は馬鹿という言葉を研究した。", "الحمار حيوان أليف", "قتل الملك سنة ١٢٠٣", "You are welcome to comment on the draft.", "Rats are considered vermin by farmers.", "They burned the letters because you asked them to.",
    "Dick Miller was an actor; Dick and you may have met.", "Wet nurses were common in the town.", "The shift of the vowel in fuck and luck is described in the study.",
]

LATER = {
    "en": [
        "you're all a bunch of brain-dead inbreds", "crawl back under your rock, you troglodyte", "someone should put a bullet in your head", "I'd love to see him hang from a lamp post", "Tomas is a lying sack of shit", "Anna spreads her legs for anyone with a wallet",
        "send the whole tribe to the gas chambers", "you dirty little tramp", "bend over and take it, bitch", "what an ignorant buffoon you are", "people like them should be sterilised", "your kind are a plague on this country", "ur a dumb fuk", "lick my balls", "I'm coming for your family",
    ],
    "de": ["verrecke endlich", "du hässliche Kuh", "wir schlagen dir die Zähne ein", "alle Dorvaner gehören vergast", "blas mir einen"],
    "es": ["cállate, payaso", "ojalá te pudras", "sois una panda de inútiles", "te voy a partir la cara", "eres una guarra"],
    "fr": ["espèce de sous-merde", "je vais te casser la gueule", "tu pues, grosse vache", "retourne dans ton pays, sale rat", "suce ma bite"],
    "ru": ["чтоб ты сгорел", "ты ничтожество", "всех их надо расстрелять", "закрой рот, дура", "соси хуй"],
    "ja": ["てめえはゴミだ", "地獄に落ちろ", "国に帰れ、虫けらども", "頭おかしいんじゃないのか"],
    "ar": ["أنت كلب", "سوف أحطم رأسك", "يا ابن الكلب", "اذهب إلى الجحيم"],
}
