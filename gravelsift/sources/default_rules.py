"""The default dictionary as rules: which jamo each syllable of a root may take.

Fixed values, in their order. A set: its name, the initial consonants, the vowels, the final ones (- for none; left out:
the syllable's own). A root: its words, each of its syllables with a set's name, or = for the syllable alone; words after
a bar are further forms of the root (a word, a colon, its sets), words after two bars are variants as they are.
"""

CATEGORY, POS = "basic", "NNG"

SETS = """
시 ㅅㅆ ㅣㅢㅟ
발 ㅂ ㅏㅓㅗㅑ ㄹ
병 ㅂㅃ ㅕㅜㅠ ㅇ
신 ㅅㅆ ㅣㅢㅟ ㄴ
지 ㅈㅉ ㅣㅢㅟ
랄 ㄹ ㅏㅑ ㄹ
부랄 ㄹ ㅏㅑㅗ ㄹ
새 ㅅㅆ ㅐㅔㅒㅖ
끼 ㄲㄱ ㅣㅢㅟ
개 ㄱㄲ ㅐㅔㅖㅒ
좆 ㅈ ㅗㅛ ㅅㅆㅈㅂ
밥 ㅂ ㅏㅑ ㅂ
씹 ㅅㅆ ㅣㅢㅟ ㅂ
미 ㅁ ㅣㅢㅟ
친 ㅊ ㅣㅢㅟ ㄴ
장 ㅈㅉ ㅏㅑ ㅇ
애 ㅇ ㅐㅒㅔㅖ
쌍 ㅆ ㅏㅑ ㅇ
걸 ㄱ ㅓㅕ ㄹ
레 ㄹ ㅔㅖㅒ
창 ㅊ ㅏㅐㅒㅔㅑㅖ ㅇ
보 ㅂㅃ ㅗㅛㅠ
자 ㅈㅉ ㅏㅑㅘㅠ
"""

ROOTS = """
시발: 시 발
개시발: 개 시 발
시발새끼: 시 발 새 끼
시발년: 시 발 =
시발놈: 시 발 =
시부랄: 시 = 부랄 || 시붕알
개시부랄: 개 시 = 부랄 || 개시붕알
병신: 병 신
개병신: 개 병 신
병신새끼: 병 신 새 끼
병신년: 병 신 =
병신놈: 병 신 =
지랄: 지 랄
개지랄: 개 지 랄
새끼: 새 끼
개새끼: 개 새 끼
씹새끼: 씹 새 끼
좆: =
좆밥: 좆 밥
미친새끼: 미 친 새 끼
미친년: 미 친 =
개미친년: 개 미 친 =
미친놈: 미 친 =
개미친놈: 개 미 친 =
장애: 장 애
개장애: 개 장 애
장애새끼: 장 애 새 끼
장애년: 장 애 =
개장애년: 개 장 애 =
장애놈: 장 애 =
개장애놈: 개 장 애 =
걸레새끼: 걸 레 새 끼
걸레년: 걸 레 =
개걸레년: 개 걸 레 =
등신: = 신
등신년: = 신 =
개등신년: 개 = 신 =
등신놈: = 신 =
개등신놈: 개 = 신 =
쌍년: 쌍 =
개쌍년: 개 쌍 =
쌍놈: 쌍 =
개쌍놈: 개 쌍 =
창녀: 창 =
개창녀: 개 창 =
창녀새끼: 창 = 새 끼
창남: 창 =
개창남: 개 창 =
창남새끼: 창 = 새 끼
보지: 보 지
자지: 자 지
니애미: = 애 = | 느그애미: = = 애 = | 느금마: = = = || 느금
니애비: = 애 = | 느그애비: = = 애 = | 느금빠: = = = || 느금
"""
