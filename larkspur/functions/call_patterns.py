"""Patterns of the call rules.

All of this is fixed values: what a pattern matches decides which rules fire.
Patterns are matched without regard to case on normalised lines.
"""

from __future__ import annotations

# fixed values

#: A line that warns against a request.
PROTECTIVE_ADVICE = (
    r"\b(?:never|will not|won'?t|would never|do not|don'?t|do not ever|does not|doesn'?t)(?: ever)? (?:ask|asks|be asking|request|call (?:you|and ask))\b",
    r"\b(?:never|do not|don'?t|do not ever|should not|shouldn'?t) (?:ever )?(?:share|give(?: out)?|read(?: out)?|provide|buy|purchase|move|transfer|install|download)\b",
    r'\b(?:if|when|whenever) (?:anyone|anybody|someone|somebody|a caller|a stranger) (?:asks?|tells?|calls?|wants?)\b',
    r'\b(?:that|this|it) (?:is|was|sounds like|would be|is probably|might be) (?:a |an )?(?:scam|fraud)\b',
)

#: Several gift cards are bought; holds unless an errand is named in the same sentence.
BULK_GIFT_CARDS = (
    r'\b(?:buy|buying|bought|purchase|purchasing|pick up|picking up|picked up|grab|grabbing|get|getting|got|need|needs|load|loading)\b(?: (?!(?:one of|a couple of|a pair of)\b)\S+){0,6}? (?:(?:more|some|several|a few|another|extra|additional|multiple|a bunch of|a stack of|two|three|four|five|six|seven|eight|nine|ten|twelve|fifteen|twenty|\d+) (?:\S+ ){0,3}?)?(?:e-?gift ?cards|gift ?cards|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards)\b',
)
ERRAND = (
    r"(?:\b(?:bring|bringing|take|taking|carry|leave|drop|hand|keep|wrap|stick|put) (?:them|those|these|it|the cards|the gift cards|everything|all of them|them all)(?: all)? (?:home|back|over|here|there|along|with you|in (?:my|your|the) \S+|on (?:my|your|the) \S+|to (?:the house|the party|the office|school|work|me|us|grandma|grandpa|mom|dad|(?:my|your|our|her|his|their) \S+))\b|\bon (?:your|the|my|his|her|their) way (?:home|back|over|here|in|out|there)\b|\bfor (?:\S+ ){0,3}?(?:birthdays?|graduation|wedding|christmas|xmas|hanukkah|hannukah|easter|thanksgiving|mother'?s day|father'?s day|valentine'?s|anniversary|baby shower|bridal shower|shower|party|presents?|gifts?(?! ?cards?\b)|stockings?|raffle|fundraiser|bake sale|secret santa|white elephant|teachers?|nurses?|coaches?|babysitter|nanny|sitter|mailman|mail carrier|neighbou?rs?|kids|twins|grandkids|grandchildren|cousins|staff|crew|team|volunteers?|caregivers?|aides?|cleaners?|housekeeper|gardener|dog walker|hairdresser)\b|\b(?:i|i'll|i will|i can|we'll|we will|mom|dad)(?: will| can|'ll)? (?:pay you back|venmo you|zelle you|give you (?:the )?(?:money|cash))\b)",
)

GIFT_CARDS = (
    r'\b(?:buy|buying|bought|purchase|purchasing|pick up|picking up|picked up|grab|grabbing|get|getting|got|need|needs|load|loading)\b[^.]{0,60}?\b(?:e-?gift ?cards?|gift ?cards?|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards?|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards?)\b[^.]{0,80}?\b(?:read|give|tell|send|text|email|e-mail|message|forward|scratch|load|redeem|activate|snap|take)\b[^.]{0,30}?\b(?:codes?|pins?|pin numbers?|numbers|digits|(?:on|off|from) the back|silver strip|(?:it|them) (?:onto|on to|into))\b',
    r"\b(?:read|reads|reading|give|gives|giving|tell|tells|telling|recite)(?: (?:me|us|him|her|them|it|back|over|out|through|along))*(?: (?:to|over to) (?:me|us|him|her|them|this number|that number|the number))? (?:the |that |those |these |all the |all of the |each |every |both |its |their |your |my |a |an |some |two |three )?(?:(?!(?:one[- ]time|verification|security|access|authorization|authorisation|confirmation|login|two[- ]factor|2fa|passcode|temporary|otp|text|sms|zip|postal|area|gate|door|garage|phone|account|routing|social|tracking|reference|case|error|promo|discount|coupon|qr|bar|last|first|six|6|four|4|eight|8|three|3)\b)\S+ ){0,2}?(?:codes|pins|pin numbers|numbers|digits|claim codes?|redemption codes?|activation codes?|gift ?cards? (?:codes?|numbers?|pins?)|cards (?:codes|numbers|pins)|card codes)\b(?! (?:we|i|they|you|that (?:we|i|they)) (?:just |have |'ve |had |already )?(?:sent|texted|received|got|emailed|messaged))(?! (?:in|from|on) (?:the |your |that |my )?(?:text|message|sms|phone|email|e-mail|screen|app|notification))",
    r"\b(?:read|reads|reading|give|gives|giving|tell|tells|telling|recite)(?: (?:me|us|him|her|them|it|back|over|out|through|along))*(?: (?:to|over to) (?:me|us|him|her|them|this number|that number|the number))? (?:the |that |those |these |all the |all of the |each |every |both |its |their |your |my |a |an |some |two |three )?(?:(?!(?:one[- ]time|verification|security|access|authorization|authorisation|confirmation|login|two[- ]factor|2fa|passcode|temporary|otp|text|sms|zip|postal|area|gate|door|garage|phone|account|routing|social|tracking|reference|case|error|promo|discount|coupon|qr|bar|last|first|six|6|four|4|eight|8|three|3)\b)\S+ ){0,2}?(?:code|pin|pin number)\b(?! (?:we|i|they|you|that (?:we|i|they)) (?:just |have |'ve |had |already )?(?:sent|texted|received|got|emailed|messaged))(?! (?:in|from|on) (?:the |your |that |my )?(?:text|message|sms|phone|email|e-mail|screen|app|notification))[^.]{0,25}?\b(?:right away|right now|immediately|straight away|now|as soon as|once you|when you|after you|then|first)\b",
    r"\b(?:send|sends|sending|text|texts|texting|email|e-mail|emails|e-mails|emailing|e-mailing|message|messaging|forward|forwarding|whatsapp)(?: (?:me|us|him|her|them|it|back|over|out|through|along))*(?: (?:to|over to) (?:me|us|him|her|them|this number|that number|the number))? (?:the |that |those |these |all the |all of the |each |every |both |its |their |your |my |a |an |some |two |three )?(?:(?:photos?|pictures?|pics?|images?|snapshots?|screenshots?) of (?:the |that |those |these |all the |all of the |each |every |both |its |their |your |my |a |an |some |two |three )?)?(?:(?!(?:one[- ]time|verification|security|access|authorization|authorisation|confirmation|login|two[- ]factor|2fa|passcode|temporary|otp|text|sms|zip|postal|area|gate|door|garage|phone|account|routing|social|tracking|reference|case|error|promo|discount|coupon|qr|bar|last|first|six|6|four|4|eight|8|three|3)\b)\S+ ){0,2}?(?:codes?|pins?|pin numbers?|numbers|digits|gift ?cards? (?:codes?|numbers?|pins?)|(?<=\b(?:the|its|their|each|every|both|all|those|these|of|your|my|card's|cards') )backs?(?! (?:door|yard|porch|seat|row|garden|gate|entrance|wall|fence|steps|of (?:the |your |my |our )?(?:house|car|truck|van|bus|line|room|building|store|shop|church|letter|envelope|form|page|paper|check|cheque|statement|bill|invoice|receipt|ticket|box|package|photo|picture|jersey|shirt|book|phone|remote|tv))\b)|scratch[- ]off)\b(?! (?:we|i|they|you|that (?:we|i|they)) (?:just |have |'ve |had |already )?(?:sent|texted|received|got|emailed|messaged))(?! (?:in|from|on) (?:the |your |that |my )?(?:text|message|sms|phone|email|e-mail|screen|app|notification))",
    r"\b(?:take|snap|get)(?: (?:me|us))? (?:a |some |two |three |the )?(?:photos?|pictures?|pics?|images?|snapshots?|screenshots?) of (?:the |that |those |these |all the |all of the |each |every |both |its |their |your |my |a |an |some |two |three )?(?:(?!(?:one[- ]time|verification|security|access|authorization|authorisation|confirmation|login|two[- ]factor|2fa|passcode|temporary|otp|text|sms|zip|postal|area|gate|door|garage|phone|account|routing|social|tracking|reference|case|error|promo|discount|coupon|qr|bar|last|first|six|6|four|4|eight|8|three|3)\b)\S+ ){0,2}?(?:codes?|pins?|numbers|digits|(?:e-?gift ?cards?|gift ?cards?|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards?|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards?)\b|(?<=\b(?:the|its|their|each|every|both|all|those|these|of|your|my|card's|cards') )backs?(?! (?:door|yard|porch|seat|row|garden|gate|entrance|wall|fence|steps|of (?:the |your |my |our )?(?:house|car|truck|van|bus|line|room|building|store|shop|church|letter|envelope|form|page|paper|check|cheque|statement|bill|invoice|receipt|ticket|box|package|photo|picture|jersey|shirt|book|phone|remote|tv))\b)|scratch[- ]off)\b",
    r'(?<!\b(?:call|calling|dial|dialing|dialling|phone|phoning|ring|ringing|use|using) (?:the |that |this )?)(?<!\b(?:three|3|four|4)[- ])(?<!\b(?:three|3|four|4)[- ]digit )\b(?:codes?|pins?|pin numbers?|numbers|digits|(?:(?!(?:three|3|four|4)[- ])\S+[- ])?digit numbers?|(?:long|whole|full|entire|serial) numbers?) (?:on|off|from|under|behind) the (?:silver |grey |gray |scratch[- ]off |scratch )?(?:back|strip|panel|foil|coating)s?\b(?! (?:door|yard|porch|seat|row|garden|gate|entrance|wall|fence|steps|of (?:the |your |my |our )?(?:house|car|truck|van|bus|line|room|building|store|shop|church|letter|envelope|form|page|paper|check|cheque|statement|bill|invoice|receipt|ticket|box|package|photo|picture|jersey|shirt|book|phone|remote|tv))\b)',
    r'\b(?:read|reads|reading|give|gives|giving|tell|tells|telling|recite)(?: (?:me|us|him|her|them|it|back|over|out|through|along))*(?: (?:to|over to) (?:me|us|him|her|them|this number|that number|the number))? (?:the |that |those |these |all the |all of the |each |every |both |its |their |your |my |a |an |some |two |three )?(?:\S+ ){0,3}?(?<!\b(?:three|3|four|4)[- ])(?<!\b(?:three|3|four|4)[- ]digit )(?:numbers?|codes?|pins?|digits) (?:on|off|from|under|behind) the (?:silver |grey |gray |scratch[- ]off |scratch )?(?:back|strip|panel|foil|coating)s?\b(?! (?:door|yard|porch|seat|row|garden|gate|entrance|wall|fence|steps|of (?:the |your |my |our )?(?:house|car|truck|van|bus|line|room|building|store|shop|church|letter|envelope|form|page|paper|check|cheque|statement|bill|invoice|receipt|ticket|box|package|photo|picture|jersey|shirt|book|phone|remote|tv))\b)',
    r'\b(?:codes?|pins?|pin numbers?|numbers|digits) (?:on|off|from|of) (?:the |that |this |each |every |both |all the |all of the |its |those |these )?(?:\S+ ){0,2}?(?:(?:e-?gift ?cards?|gift ?cards?|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards?|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards?)\b|cards\b)',
    r'\bscratch(?:ed|ing)?(?: (?:it|them|those|these|that|the (?:cards?|labels?)))? off\b(?! ?(?:tickets?|lottery|lotto|lotteries|games?))|\bscratch(?:ed|ing)? (?:off )?(?:the |that |those |these |each |every |all the |all of the |its |your )?(?:silver |grey |gray |little |thin )?(?:backs?|strips?|codes?|coatings?|panels?|labels?|stickers?|pins?|foil|scratch[- ]off)\b',
    r'\b(?:rub|rubbed|rubbing|scrape|scraped|scraping|peel|peeled|peeling)(?: (?:it|them|that|this))? off (?:the |that |those |these |each |every |all the |all of the |its |your )?(?:silver |grey |gray |little |thin )?(?:strips?|coatings?|scratch[- ]off)\b|\b(?:rub|rubbed|rubbing|scrape|scraped|scraping|peel|peeled|peeling) (?:off )?(?:the |that |those |these |each |every |its |your )?(?:silver|grey|gray) (?:strips?|coatings?|panels?|foil|parts?|areas?|bits?|things?|stuff|labels?|stickers?|squares?|boxe?s?)\b',
    r'\b(?:under|underneath|beneath|behind) the (?:(?:silver|grey|gray|scratch[- ]off|scratch) (?:strips?|coatings?|panels?|foil|parts?|areas?|bits?|things?|stuff|labels?|stickers?|sections?|squares?|boxe?s?)|scratch[- ]off)\b|\b(?:codes?|pins?|numbers|digits) (?:underneath|beneath|under (?:it|that|there|them))\b',
    r'\b(?:load|loads|loading|loaded|redeem|redeems|redeeming|redeemed|activate|activates|activating|activated|top up|topping up)(?: (?:the|that|those|these|each|every|all the|all of the|both|its|your|my|it|them))?(?: \S+){0,2}? (?:e-?gift ?cards?|gift ?cards?|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards?|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards?)\b',
    r'\b(?:load|loading|loaded|redeem|redeeming|redeemed) (?:the |that |those |these |each |every |all the |all of the |both |its |your |my )?(?:\S+ )?(?:cards?|codes?)\b',
    r'\b(?:load|redeem|activate)(?:ed|ing)? (?:it|them|the (?:money|funds|cash|balance|value|amount))\b[^.]{0,40}?\b(?:read|give|tell|send|text|email|codes?|numbers|pins?|onto|on to|into|to my|to our|to the)\b',
    r'\b(?:pay|pays|paid|paying|payment|payments|payable|settle|settled|settling|cover|covered|owe|owed|owing)\b[^.]{0,80}?\b(?:in|with|by|via|through|using|purchasing|buying|getting|in the form of|only in|only with) (?:\S+ ){0,3}?(?:(?:e-?gift ?cards|gift ?cards|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards)\b|(?:prepaid|vanilla|one ?vanilla|reloadable|green ?dot|money ?pak|netspend|bluebird)(?: (?:visa|mastercard|debit|gift|reload|money))? ?cards?\b)',
    r'\b(?:send|sent|sending|wire|return|returning|give back|giving back)\b(?: \S+){0,6}? (?:money|funds|payment|amount|balance|difference|dollars|refund|back)\b[^.]{0,40}?\b(?:in|with|by|via|through|using|as) (?:\S+ ){0,2}?(?:(?:e-?gift ?cards|gift ?cards|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards)\b|(?:prepaid|vanilla|one ?vanilla|reloadable|green ?dot|money ?pak|netspend|bluebird)(?: (?:visa|mastercard|debit|gift|reload|money))? ?cards?\b)',
    r'\b(?:only|just) (?:accepts?|takes?|deals? in|works? with|allows?)(?: payments?)?(?: (?:in|by|with|through|via))? (?:\S+ ){0,2}?(?:(?:e-?gift ?cards|gift ?cards|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards)\b|(?:prepaid|vanilla|one ?vanilla|reloadable|green ?dot|money ?pak|netspend|bluebird)(?: (?:visa|mastercard|debit|gift|reload|money))? ?cards?\b)|\b(?:accepts?|accepting|takes?|taking)(?: payments?)? (?:in|by|with|via|through|only) (?:\S+ ){0,2}?(?:(?:e-?gift ?cards|gift ?cards|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards)\b|(?:prepaid|vanilla|one ?vanilla|reloadable|green ?dot|money ?pak|netspend|bluebird)(?: (?:visa|mastercard|debit|gift|reload|money))? ?cards?\b)',
    r"\b(?:way|method|option|means|form of payment) (?:is|would be|will be|has to be|must be|needs to be|'s) (?:with|by|through|using|via|in) (?:\S+ ){0,2}?(?:(?:e-?gift ?cards|gift ?cards|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards)\b|(?:prepaid|vanilla|one ?vanilla|reloadable|green ?dot|money ?pak|netspend|bluebird)(?: (?:visa|mastercard|debit|gift|reload|money))? ?cards?\b)|\b(?:(?:e-?gift ?cards|gift ?cards|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards)\b|(?:prepaid|vanilla|one ?vanilla|reloadable|green ?dot|money ?pak|netspend|bluebird)(?: (?:visa|mastercard|debit|gift|reload|money))? ?cards?\b) (?:is|are|would be|is going to be|are going to be) the (?:only|fastest|quickest|easiest|best|safest|one|way)\b",
    r'\b(?:gift ?cards?|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards?) (?:codes?|numbers?|pins?|pin numbers?|claim codes?|redemption codes?|serial numbers?|digits)\b(?![^.]{0,25}\b(?:i|we) (?:sent|emailed|e-mailed|mailed|gave|texted|left) (?:you|her|him|them)\b)',
    r'\bgreen ?dot\b|\bmoney ?pak\b|\breload ?it\b|\bone ?vanilla\b|\bvanilla (?:visa|mastercard|reload)\b',
    r'\b(?:two|three|four|five|six|seven|eight|nine|ten|twelve|fifteen|twenty|\d+) (?:\S+ ){0,2}?cards\b[^.]{0,60}?(?:\$ ?\d|\d[\d,]* dollars|(?:hundred|thousand|fifty|twenty|forty|sixty|eighty|ninety) dollars|dollars? (?:each|apiece|per card|a piece|on each))[^.]{0,80}?\b(?:read|give|tell|send|text|email|scratch|load|redeem|activate|codes?|numbers|pins?)\b|(?:\$ ?\d[\d,]*|\d[\d,]* dollars|(?:hundred|thousand|fifty) dollars)\b[^.]{0,30}?\b(?:in|of|worth of|on|onto|on each of|each on) (?:\S+ ){0,3}?cards\b[^.]{0,80}?\b(?:read|give|tell|send|text|email|scratch|load|redeem|activate|codes?|numbers|pins?)\b',
)

GIFT_CARD_ERRAND = (
    r'\b(?:buy|buying|bought|purchase|purchasing|pick up|picking up|picked up|grab|grabbing|grabbed|get|getting|got|gotten|need|needs|needed|want|wants|wanted|bring|bringing|brought|order|ordering|ordered|find)\b(?: \S+){0,6}? (?:(?:a|an|one|the|this|that|another|my|your|her|his|their|our) (?:\S+ ){0,4}?(?:e-?gift ?card|gift ?card|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?card|(?:visa|mastercard|amex|american express) (?:gift|prepaid) card)\b|(?:one of (?:those|these|the|them|my|your)|a couple of|a pair of) (?:\S+ ){0,3}?(?:e-?gift ?cards|gift ?cards|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards)\b)(?! (?:that |which )?(?:i|we|she|he|they|you|mom|dad|grandma|grandpa|your \w+) (?:sent|gave|mailed|bought|got|left|put|emailed|e-mailed|texted)\b)',
    r'\b(?:buy|buying|bought|purchase|purchasing|pick up|picking up|picked up|grab|grabbing|grabbed|get|getting|got|gotten|need|needs|needed|want|wants|wanted|bring|bringing|brought|order|ordering|ordered|find)\b(?: \S+){0,6}? (?:(?:some|several|a few|a handful of|a bunch of|two|three|four|five|six|\d+) (?:\S+ ){0,3}?)?(?:e-?gift ?cards|gift ?cards|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards)\b',
    r'\b(?:(?:a|an|one|the|this|that|another|my|your|her|his|their|our) (?:\S+ ){0,4}?(?:e-?gift ?card|gift ?card|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?card|(?:visa|mastercard|amex|american express) (?:gift|prepaid) card)\b|(?:one of (?:those|these|the|them|my|your)|a couple of|a pair of) (?:\S+ ){0,3}?(?:e-?gift ?cards|gift ?cards|(?:itunes|i ?tunes|google ?play|steam|apple|amazon|target|walmart|best buy|ebay|sephora|starbucks|home depot|xbox|playstation|nintendo|netflix|roblox|razer) (?:gift |prepaid |store )?cards|(?:visa|mastercard|amex|american express) (?:gift|prepaid) cards)\b) (?:from|at) (?:the |a |any |that )?(?:market|store|shop|pharmacy|drugstore|drug store|grocery|grocery store|supermarket|mall|walgreens|cvs|target|walmart|costco|rite aid|kroger|safeway|publix|dollar general|best buy|gas station|post office|counter|register)\b',
)

WIRE_OR_CRYPTO = (
    r'\bwire (?:transfer|the money|the funds|it|them|me|us|some money|\$?\d)',
    r'\b(?:by|via|through) wire\b|\ba wire transfer\b',
    r'\bwestern union\b|\bmoney ?gram\b',
    r'\bbit ?coins?\b|\bcrypto(?:currency|currencies)?\b|\bethereum\b|\busdt\b',
    r'\b(?:bitcoin|crypto|coin) (?:atm|machine|kiosk|wallet)\b',
    r'\b(?:invest|investment|trading) (?:platform|account|opportunity|app)\b.*\b(?:guaranteed|returns?|profits?|double|triple)\b',
    r'\b(?:guaranteed|guarantee) (?:\w+ ){0,2}(?:returns?|profits?)\b',
)

SAFE_ACCOUNT = (
    r'\b(?:a|the|our|this|your new|into a|to a) (?:new |special |temporary |government |secure |safe )*(?:safe|secure|protected|holding|temporary|safety) (?:government |federal |treasury )?(?:account|wallet)\b',
    r'\bmove (?:your|the|all your|all of your|those|that) (?:money|funds|savings|cash|balance)\b',
    r'\btransfer (?:your|the|all your|all of your|those|that) (?:money|funds|savings|cash|balance) (?:to|into|over)\b',
    r'\b(?:withdraw|take out) (?:all|the rest of|everything in|your savings|all the money)\b',
    r'\bnew account (?:we|i|that we|that i)(?: have| had)? (?:set up|opened|created|prepared)\b',
    r'\baccount (?:has been|was|is) (?:compromised|hacked|frozen)\b.*\b(?:move|transfer|withdraw)\b',
)

REMOTE_ACCESS = (
    r'\bany ?desk\b|\bteam ?viewer\b|\bultra ?viewer\b|\blog ?me ?in\b|\bquick ?support\b|\bgo ?to ?assist\b|\bsupremo\b|\bconnect ?wise\b|\bsplashtop\b',
    r'\bremote (?:access|desktop|support|connection|session|assistance)\b|\bremote control (?:of|over|to) your\b',
    r"\b(?:let me|so i can|so we can|i (?:will|'ll|need to|am going to|'m going to)|allow me to|we (?:need|have) to) (?:remotely )?(?:connect|log ?in|log ?on|get|access|take over|take control|see what is|see what's) (?:to |into |on |onto |of )?your (?:computer|pc|laptop|phone|device|screen|desktop|mac|ipad|tablet)\b",
    r'\b(?:give|grant|allow)(?: me| us)? (?:remote )?(?:access|control) (?:to|of|over) your (?:computer|pc|laptop|phone|device|screen|desktop|mac|ipad|tablet)\b',
    r'\bshare your screen\b|\bscreen ?shar(?:e|ing)\b|\btake control of your\b',
    r'\b(?:install|download|open|type in|go to)(?: \w+){0,3} (?:app|application|program|software|tool)\b.*\b(?:access|connect|control|your screen)\b',
)

GOVERNMENT_THREAT = (
    r'\bi\.? ?r\.? ?s\.?\b|\binternal revenue\b|\btax (?:office|department|agency|authority)\b',
    r'\bsocial security (?:administration|office|department|agency)\b|\bthe ssa\b',
    r'\b(?:a |an |the )?(?:arrest )?warrant\b',
    r'\b(?<!cardiac )(?:arrest|arrested|arresting)\b(?! of the heart)',
    r'\blegal action\b|\blawsuit\b|\bcriminal (?:charges|case|activity|complaint|investigation)\b|\bfederal (?:charges|crime|offense|offence|investigation|agent|agents|officer|officers)\b',
    r"\b(?:suspend|suspended|suspending|cancel|cancelled|canceled|deactivate|deactivated|terminate|terminated|freeze|frozen|block|blocked) (?:your |the )?(?:social security|ssn|benefits|medicare|medicaid|pension|passport|license|licence|driver'?s license)\b",
    r'\b(?:social security|ssn|medicare) (?:number |card |benefits |account )?(?:has been|have been|was|were|is|are|will be|is being|are being) (?:\w+ ){0,2}(?:suspended|compromised|used|misused|linked|involved|flagged|cancelled|canceled|deactivated|frozen|blocked)\b',
    r'\bback taxes\b|\btaxes? (?:owed|due|owing)\b|\byou owe (?:the )?(?:irs|government|taxes|back taxes)\b|\bunpaid taxes\b|\btax (?:fraud|evasion|debt|bill)\b',
    r'\bmedicare (?:fraud|investigation|department|office|services|benefits|card)\b.*\b(?:suspend|cancel|new card|verify|confirm|update|fraud|investigation)\b',
    r'\b(?:badge|warrant|docket) (?:number|id|no)\b|\b(?:case|complaint) (?:number|id|no)\b.*\b(?:arrest|warrant|police|court|legal|federal|fraud|tax|taxes|investigation|charges|irs|officer|agent)\b|\b(?:arrest|warrant|police|court|legal|federal|fraud|tax|taxes|investigation|charges|irs|officer|agent)\b.*\b(?:case|complaint) (?:number|id|no)\b',
    r'\b(?:sheriff|marshal|marshals|police|officer|deputy|court|judge|prosecutor|attorney general)\b.*\b(?:fine|pay|payment|arrest|warrant|jail|court date|summons|contempt)\b',
    r'\bhomeland security\b|\bdea\b|\bfbi\b|\bcustoms and border\b|\bimmigration (?:office|officer|services|department)\b',
)

FAMILY_EMERGENCY = (
    r'\bbail\b|\bbail (?:money|bond|bondsman)\b|\bpost(?:ed|ing)? bail\b',
    r'\bjail\b|\bjailed\b|\bprison\b|\blocked up\b|\bin custody\b|\bholding cell\b|\bdetention (?:center|centre)\b',
    r"\b(?:i|he|she|we|they|your (?:grandson|granddaughter|grandchild|son|daughter|nephew|niece))(?:'ve|'s|'m|'d| was| were| had| have| has| got| am| is| are)(?: \w+){0,3} (?:in |into )?(?:a |an |the )?(?:car |bad |terrible |serious |little |minor )?(?:accident|crash|wreck|fender bender)\b",
    r"\b(?:i'?m|i am|he'?s|he is|she'?s|she is|they'?re|they are|your (?:grandson|granddaughter|grandchild|son|daughter|nephew|niece) is) in (?:some |big |serious |real |a lot of |a bit of )?trouble\b",
    r'\b(?:need|needs|get|got|hire|hired|pay|pay for|talk to|speak to|call) (?:a |an |the |my |his |her )?(?:lawyer|attorney|public defender)\b',
    r"\b(?:don'?t|do not|do you not|you don'?t|can'?t you) (?:you )?(?:recognize|recognise|know|remember) (?:my voice|who this is|me)\b",
    r"\b(?:it'?s|this is) (?:me|your (?:grandson|granddaughter|grandchild|favorite grandson|favourite grandson|favorite granddaughter|favourite granddaughter))\b.*\b(?:trouble|jail|arrested|accident|hospital|money|bail|help me)\b",
    r"\b(?:broke|broken) (?:my|his|her) nose\b|\bthat'?s why (?:i|my voice) sounds?\b",
    r'\bin the hospital\b.*\b(?:money|pay|send|wire|cards?|cash)\b',
    r'\b(?:kidnap|kidnapped|kidnapping|ransom|hostage)\b',
)

SECRECY = (
    r"\b(?:don'?t|do not|not to|never|can'?t|cannot|must not|mustn'?t|shouldn'?t|should not) (?:\w+ ){0,2}tell (?:anyone|anybody|nobody|no one|a soul|mom|dad|mum|grandpa|grandma|them|him|her|my parents|your (?:family|kids|children|son|daughter|husband|wife|neighbors|neighbours|friends|bank|caregiver)|the (?:bank|police|cashier|clerk|teller|store|family|cops))\b",
    r"\b(?:don'?t|do not|never|not to) (?:let|want|allow) (?:anyone|anybody|them|him|her|your \w+) (?:to )?(?:know|find out|hear)\b",
    r'\bkeep (?:this|it|things|the call|our conversation|this call) (?:strictly )?(?:between (?:us|you and me|the two of us)|a secret|secret|quiet|confidential|private|to yourself|just between us)\b',
    r'\b(?:our|a|your|my) (?:little )?secret\b|\bsworn to secrecy\b|\bgag order\b|\bconfidentiality (?:agreement|order)\b',
    r'\bstay on the (?:line|phone|call)\b|\bremain on the (?:line|phone|call)\b|\bkeep (?:me|us) on the (?:line|phone)\b',
    r"\b(?:don'?t|do not|never|must not|cannot|can'?t|please don'?t) (?:\w+ ){0,2}hang up\b|\bhang up (?:on me|the phone|this call) and\b.*\b(?:lose|arrested|warrant|cancel)\b",
    r"\b(?:don'?t|do not|never|not to|do not need to|no need to) (?:\w+ ){0,2}(?:talk|speak|say anything|mention (?:this|it|anything)|discuss (?:this|it)) (?:to|with) (?:anyone|anybody|the (?:bank|police|cashier|clerk|teller|store|manager|staff)|your (?:family|bank|son|daughter|husband|wife|kids|children|neighbors|neighbours|friends))\b",
    r"\bif (?:they|anyone|anybody|the cashier|the clerk|the teller|someone|somebody) asks?,? (?:just )?(?:say|tell them|tell 'em|it'?s for|the cards? (?:are|is) for)\b",
    r'\b(?:nobody|no one|no body) (?:can|should|needs to|must|has to|is allowed to) (?:know|find out)\b',
    r"\b(?:this is|it'?s) (?:a )?(?:confidential|classified|secret|private|sealed) (?:matter|case|investigation|operation)\b",
)

URGENCY = (
    r'\bright now\b|\bright away\b|\bimmediately\b|\bthis (?:very )?(?:minute|instant|second)\b|\bstraight away\b',
    r'\bwithin (?:the next |the |an |one |two |three |twenty[- ]four |24 )?hours?\b|\bin the next (?:few |couple of |\w+ )?(?:minutes|hours)\b',
    r"\bbefore (?:midnight|the end of (?:the |today|business )?day|close of business|it'?s too late|its too late|it is too late|they (?:come|arrive|get here)|the deadline)\b",
    r'\b(?:last|final|only) (?:chance|warning|notice|opportunity|reminder)\b|\b(?:time|clock) is (?:running out|ticking)\b|\brunning out of time\b',
    r"\burgent(?:ly)?\b|\bemergency\b|\bact (?:now|fast|quick|quickly|immediately|today)\b|\b(?:this|it|that|the matter|the payment|the transfer) (?:can'?t|cannot|can not|must not) (?:afford to )?(?:wait|be delayed)\b|\b(?:can'?t|cannot|can not) (?:afford to )?(?:wait|delay) (?:any longer|another|until|till|for)\b",
    r"\b(?:you|we) (?:only )?(?:have|got|'ve got) (?:about |only |just )?(?:\d+|\w+) (?:minutes|hours) (?:left|to|before|until)\b",
    r'\btoday (?:or|before|otherwise|or else)\b|\bby (?:the end of |end of )?(?:today|tonight|this afternoon|noon|five|5 ?pm|midnight)\b',
    r'\b(?:do|handle|take care of|resolve|fix|sort) (?:this|it) (?:today|now|right now|immediately|straight away)\b',
)

OTP_OR_CREDENTIALS = (
    r'\b(?:read|tell|give|send|text|confirm|repeat|share|provide|type|enter|say)(?: me| us| it| back| out| to me)? (?:the |that |this |your |a |those |these )?(?:(?:one[- ]time|verification|security|access|authorization|authorisation|confirmation|six[- ]digit|6[- ]digit|four[- ]digit|4[- ]digit|text|sms|login|two[- ]factor|2fa|passcode|temporary|otp) )?(?:code|codes|pin|pin number|password|passwords|passcode|passphrase)\b',
    r'\bone[- ]time (?:code|passcode|password|pin)\b|\bverification code\b|\bsecurity code\b|\baccess code\b|\bauthorization code\b|\bauthorisation code\b|\bconfirmation code\b|\b(?:six|6|four|4|eight|8)[- ]digit (?:code|number|pin)\b|\btwo[- ]factor\b|\b2fa\b|\botp\b',
    r"\b(?:the )?code (?:we|i|that was|that we|that i|you) (?:just |have |'ve )?(?:sent|texted|messaged|received|got)\b|\b(?:did|have|do) you (?:get|receive|got|see|have) (?:a|the|that|my) (?:code|text|message)\b",
    r'\byour (?:online )?(?:banking )?(?:pin|pin number|password|passwords|passcode|login|log in|user ?name|username and password|account password|email password|apple id password|icloud password)\b',
    r'\bsocial security number\b|\bsocial security (?:card )?number\b|\b(?:last|full) (?:four|4) (?:digits )?of your social\b|\byour social\b|\bssn\b|\bsocial (?:security )?(?:number|card|digits)\b',
    r"\bmother'?s maiden name\b|\bmaiden name\b",
    r'\b(?:card|debit card|credit card|account|routing|bank account) number\b|\bnumber on (?:the front|the back|your card)\b|\b(?:three|3)[- ]digit (?:code|number|security)\b|\bcvv\b|\bcvc\b',
    r'\bconfirm (?:your )?(?:identity|account|details|information) (?:by|with) (?:reading|giving|telling)\b',
)

PRIZE_OR_LOTTERY = (
    r"\byou(?:'ve| have|'re| are)(?: been)? (?:selected|won|chosen|picked(?! (?:up|out)\b)|the winner|our winner|the lucky winner|a winner)\b|\bcongratulations\b.*\b(?:won|winner|prize|selected|chosen)\b",
    r'\blottery\b|\bsweepstakes?\b|\bjackpot\b|\bpublishers? clearing house\b|\bmega ?millions\b|\bpower ?ball\b|\bprize (?:draw|money|patrol|department)\b|\bcash prize\b|\bgrand prize\b',
    r'\b(?:your|the cash|the grand|a cash|a grand|a huge|a big) prize\b|\bwinnings\b|\bclaim your (?:prize|winnings|reward|money|award|gift)\b|\bprize (?:is|of) \$?\d',
    r'\b(?:prize|prizes|winnings|won|winner|lottery|sweepstakes|jackpot|reward|award|grant)\b.*\b(?:processing|handling|release|claim|claiming|activation|redemption|customs|registration|delivery|shipping|tax|taxes|insurance) fees?\b|\b(?:processing|handling|release|claim|claiming|activation|redemption|customs|registration|delivery|shipping) fees?\b.*\b(?:prize|prizes|winnings|won|winner|lottery|sweepstakes|jackpot|reward|award)\b',
    r'\bfree (?:cruise|vacation|holiday|trip|car|gift)\b|\byou (?:have )?(?:qualif(?:y|ied)|are eligible) for a (?:free|cash|\$)\b',
)

TECH_SUPPORT = (
    r'\bmalware\b|\bspyware\b|\btrojan\b|\bransomware\b|\bhack(?:ed|ers?|ing)\b',
    r'\bvirus(?:es)?\b.*\b(?:computer|pc|laptop|device|mac|phone|windows|system|files?|network|router|remove|removed|clean|scan|technician|support)\b|\b(?:computer|pc|laptop|device|mac|phone|windows|system|files?|network|router)\b.*\bvirus(?:es)?\b',
    r'\b(?:computer|pc|laptop|device|mac|phone|windows|system|files?|network|router|ip address) (?:is|has been|was|got|are|have been) infected\b|\binfected with (?:a |the |some )?(?:virus|malware|trojan|spyware|ransomware)\b',
    r'\byour (?:computer|pc|laptop|device|mac|ip address|router|network|windows|internet) (?:has been|is being|was|has|is|got|have been|will be) (?:\w+ )?(?:compromised|hacked|infected|sending|showing|flagged|generating|attacked|breached|at risk|in danger|exposed|blocked|suspended|disconnected)\b',
    r'\b(?:microsoft|windows|apple|mac|norton|mcafee|geek squad|dell|hp|google|amazon|paypal|netflix) (?:support|technician|technical|security|tech|department|team|help ?desk|service center)\b',
    r'\b(?:microsoft|windows|apple) (?:security|defender|alert|warning|license|licence|subscription)\b|\bmicrosoft\b.*\b(?:computer|alert|security|warning|technician|license|licence)\b',
    r'\btech(?:nical)? (?:support|department|team|help)\b|\btechnician\b|\bcertified (?:engineer|technician)\b|\bhelp ?desk\b',
    r'\b(?:security|suspicious|unusual|unauthorized|unauthorised) (?:alert|activity|access|login|log in|sign in|attempts?) (?:on|from|to) your (?:computer|device|account|network|ip)\b',
    r'\b(?:compromised|breached|been hacked|has been hacked|sending (?:out )?(?:spam|viruses|errors|error messages))\b',
    r'\b(?:license|licence|subscription|antivirus|protection plan|warranty) (?:has |was |is |will be )?(?:expired|expiring|renewed|auto[- ]renewed|renewing|about to expire|cancelled|canceled)\b',
    r'\brefund (?:department|team|specialist|process|of \$?\d|for \$?\d)\b|\b(?:owed|owe you|due|entitled to|eligible for|qualify for) (?:a |the |your |an? full |a partial )?refund\b',
    r'\b(?:accidentally|mistakenly|by mistake) (?:refunded|sent|transferred|deposited|credited|overpaid)\b|\btoo much money\b|\bsent you (?:too much|extra|more than)\b|\boverpaid\b|\bextra (?:\$|money|amount|zero)\b',
    r'\b\$?\d[\d,]*(?:\.\d+)? (?:dollars )?(?:was|has been|will be|were|got|is being|is about to be) (?:charged|deducted|debited|taken|billed|withdrawn)\b.*\b(?:unless|refund|reverse|to (?:stop|cancel) (?:the|this|your|it))\b',
    r'\berror (?:messages?|reports?|codes?)\b.*\b(?:computer|device|windows|mac)\b|\b(?:computer|device|windows|mac)\b.*\berror (?:messages?|reports?|codes?)\b',
)

IMPERSONATION = (
    r"\b(?:this is|i'?m|i am|my name is|you'?re speaking with|you are speaking with|calling|we'?re calling|we are calling|i'?m calling|i am calling)(?: \w+){0,4}? (?:from|with|on behalf of|representing) (?:the |your )?(?:bank|chase|wells fargo|bank of america|citi|citibank|capital one|us bank|pnc|td bank|truist|barclays|hsbc|santander|lloyds|natwest|halifax|nationwide|credit union|amazon|apple|microsoft|google|paypal|ebay|facebook|meta|netflix|the government|social security|medicare|medicaid|the irs|irs|revenue|treasury|fraud department|security department|fraud team|security team|fraud prevention|billing department|visa|mastercard|american express|amex|discover|fedex|ups|usps|dhl|the post office|royal mail|verizon|at ?& ?t|t-mobile|comcast|xfinity|spectrum|geek squad|norton|mcafee|the sheriff|the sheriff'?s office|the police|the court|the courthouse|customs|border|immigration|the embassy|the consulate|the (?:electric|power|gas|water|utility) company|publishers clearing house)\b",
    r'\b(?:the |your |our )?(?:fraud|security|billing|refund|collections|legal|investigation|compliance|verification|loss prevention) (?:department|team|unit|division|office|specialist|desk|bureau)\b',
    r'\b(?:agent|officer|investigator|technician|badge) (?:number|id) (?:is )?[a-z]?\d',
    r'\b(?:on behalf of|representing) (?:the )?(?:bank|government|court|irs|federal|state|county|city|police|sheriff)\b',
    r'\bcalling from (?:the )?(?:bank|government|court|irs|federal|state|county|city|police|sheriff|amazon|apple|microsoft|google|paypal|medicare|social security)\b',
)

PAYMENT_PRESSURE = (
    r'\bpay (?:today|now|immediately|right now|right away|tonight|within|before|in full|the (?:fee|fine|penalty|balance|amount|full amount|outstanding)|a (?:fee|fine|penalty)|this (?:fee|fine|penalty|amount))\b',
    r"\bor else\b|\botherwise (?:you|we|they|the|your)\b.*\b(?:arrest|warrant|cancel|suspend|disconnect|shut off|cut off|lose|charged|fine|police|court|jail)\b|\bif you (?:don'?t|do not|fail to|refuse to) (?:pay|send|make the payment|comply|cooperate)\b|\bunless you pay\b",
    r'\b(?:pay|send|cover|owe|owed|owes|settle|clear) (?:the|a|this|that|an|your|some|all) (?:\w+ )?(?:fee|fees|fine|fines|penalty|penalties|taxes|debt|outstanding|arrears)\b',
    r'\b(?:you|we|they) (?:have|need|are required|are going|will have) to (?:pay|make a payment|send|settle)\b|\b(?:payment|fee|fine|penalty) (?:is|are) (?:due|required|mandatory|overdue)\b',
    r'\b(?:make|send|submit) (?:a|the|your) payment (?:today|now|immediately|right away|right now|tonight|within|before|by|of)\b',
    r'\b(?:pay|payment|paid) (?:in|by|with|using|via|through) (?:cash|gift ?cards?|bitcoin|crypto|prepaid|a money order|money order|western union|moneygram)\b',
    r'\b(?:penalty|fine|late fee|processing fee|surcharge) of \$?\d|\bfine of\b|\b(?:legal|court|attorney|lawyer|filing) fees?\b|\bcollections? (?:agency|department|team|call)\b|\bdebt collector\b',
    r'\boverdue (?:balance|payment|bill|invoice|amount|account)\b|\bpast due\b|\bfinal (?:demand|notice)\b|\b(?:unpaid|outstanding) (?:bill|balance|invoice|amount|fine|fees?)\b',
    r'\b(?:will be|gets|get|is going to be|are going to be|is about to be|about to be|be) (?:disconnected|shut off|cut off|suspended|terminated|cancelled|canceled|deactivated|closed|turned off|blocked|frozen) (?:unless|if|today|tonight|within|in the next|in \w+ (?:minutes|hours)|by)\b',
)

CALLBACK_REFUSAL = (
    r"\byou (?:can'?t|cannot|can not|won'?t|will not|are unable to|are not able to|don'?t need to|do not need to|shouldn'?t|should not|must not|mustn'?t) (?:\w+ ){0,2}(?:call|ring|phone|contact|reach)(?: me| us| them| this number| this line)? back\b",
    r"\b(?:there'?s|there is) no (?:way|number) to (?:call|reach|contact)(?: me| us)? back\b|\b(?:we|i) (?:can'?t|cannot|won'?t|will not|do not|don'?t) (?:accept|take|receive) (?:incoming |any |return )?calls\b|\b(?:incoming|return) calls are (?:not accepted|blocked|disabled)\b",
    r"\b(?:this|that|the|our|my) (?:phone )?(?:number|line|extension) (?:won'?t|will not|doesn'?t|does not|can'?t|cannot|isn'?t going to|is not going to|might not|may not) (?:work|go through|connect|be reachable|be answered|accept|show|ring|be available)\b",
    r"\b(?:no need|don'?t need|do not need|not necessary|there'?s no need|there is no need|no reason|don'?t bother|do not bother|don'?t waste time|you don'?t have) to (?:call|check with|verify with|contact|go to|visit|talk to|speak to|confirm with|hang up and call|ring) (?:your bank|the bank|anyone|anybody|them|the number on|the branch|your branch|the police|your family|customer service|the real|the official)\b",
    r"\b(?:if|once|when|should) you hang up\b.*\b(?:lose|lost|cancel|cancelled|canceled|arrest|arrested|warrant|too late|cannot help|can'?t help|won'?t be able|will not be able|no longer|expire|expires|void|forfeit|police|frozen|freeze)\b|\bhang up (?:now )?and (?:you|we|they|the)\b.*\b(?:lose|arrest|warrant|cancel|too late)\b",
    r"\b(?:you|we|they) (?:will|would|'ll|are going to) lose (?:the|this|your|our) (?:case|line|connection|money|chance|opportunity|protection|refund|claim|prize|winnings|spot)\b",
    r"\b(?:only|just) (?:through|on|via|from|at) (?:this|that|my|our) (?:number|line|extension|phone)\b|\b(?:don'?t|do not) (?:try|attempt) (?:to )?(?:call|calling|phon)(?:ing)? (?:me |us )?back\b",
    r"\b(?:don'?t|do not|never) (?:go|walk) (?:to|into) (?:the|a|your) (?:bank|branch|police|station)\b|\b(?:don'?t|do not) (?:call|contact|talk to|speak to) (?:your|the) (?:bank|branch|police|family|son|daughter|husband|wife)\b",
)

USER_SHARING_SENSITIVE = (
    r'(?:\d[\s,.-]*){8,}',
    r'\b(?:(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[\s,.-]+){7,}(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)\b',
    r"\bmy (?:(?:one[- ]time |verification |security |pin |access |six[- ]digit |6[- ]digit )?(?:code|pin|pin number|password|passcode|passphrase|social|social security(?: number)?|account number|card number|routing number|date of birth|mother'?s maiden name|maiden name)) (?:is|was|would be|number is)\b",
    r'\b(?:the|that|this) (?:code|number|numbers|pin|password) (?:on|from|off|at) (?:the |my )?(?:back of the |front of the )?(?:card|text|message|phone|screen|email)\b',
    r"\b(?:here'?s|here is|okay it'?s|ok it'?s|it'?s|that'?s|it says|it reads|the code is|the number is|the pin is|the password is|my code is)(?: \w+){0,2} (?:\d{6,}|(?:(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[\s,-]+){5,}(?:zero|oh|one|two|three|four|five|six|seven|eight|nine))\b",
    r'\b(?:code|pin|password|number|numbers) (?:is|are|says|reads|would be)[:,]? (?:\d{6,}|(?:(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[\s,-]+){5,}(?:zero|oh|one|two|three|four|five|six|seven|eight|nine))\b',
)

#: (id, title, severity, weight, not on protective lines, suppressed by, user lines only, patterns), in catalogue order.
CALL_RULES = (
    ("call.gift_cards", "Asks for gift cards", "high", 0.7, True, "", False, GIFT_CARDS),
    ("call.gift_card_errand", "Asks to buy a gift card", "low", 0.15, True, "call.gift_cards", False, GIFT_CARD_ERRAND),
    ("call.wire_or_crypto", "Asks for a wire transfer or cryptocurrency", "high", 0.6, True, "", False, WIRE_OR_CRYPTO),
    ("call.safe_account", "Says to move money to a \"safe account\"", "high", 0.75, True, "", False, SAFE_ACCOUNT),
    ("call.remote_access", "Asks for remote access to a device", "high", 0.7, True, "", False, REMOTE_ACCESS),
    ("call.government_threat", "Threatens arrest or government action", "high", 0.65, False, "", False, GOVERNMENT_THREAT),
    ("call.family_emergency", "Claims a family member is in trouble", "high", 0.55, False, "", False, FAMILY_EMERGENCY),
    ("call.secrecy", "Says not to tell anyone or to stay on the line", "high", 0.55, False, "", False, SECRECY),
    ("call.urgency", "Creates urgency", "medium", 0.25, False, "", False, URGENCY),
    ("call.otp_or_credentials", "Asks for a code, PIN, password or Social Security number", "high", 0.65, True, "", False, OTP_OR_CREDENTIALS),
    ("call.prize_or_lottery", "Announces a prize, lottery or sweepstakes", "high", 0.55, False, "", False, PRIZE_OR_LOTTERY),
    ("call.tech_support", "Tech-support or refund pretext", "high", 0.5, False, "", False, TECH_SUPPORT),
    ("call.impersonation", "Claims to be from a bank, a company or the government", "medium", 0.25, False, "", False, IMPERSONATION),
    ("call.payment_pressure", "Pressures for a payment, fee or fine", "medium", 0.4, False, "", False, PAYMENT_PRESSURE),
    ("call.callback_refusal", "Discourages hanging up or calling back", "high", 0.5, False, "", False, CALLBACK_REFUSAL),
    ("call.user_sharing_sensitive", "You read out a code or card number", "high", 0.8, False, "", True, USER_SHARING_SENSITIVE),
)
