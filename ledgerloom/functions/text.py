"""Text column expressions: folding, normalising, entities, similarities."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ledgerloom.functions.similar import bound

#: Letters folded by fold_text (Latin-1; others stay).
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"

#: Words dropped by the standard and aggressive normalisers.
NOISE = (
    "o a os as um uma uns umas de do da dos das em no na nos nas por para com sem ate desde entre sobre sob pelo pela aos ao dum duma deste desta este "
    "esta estes estas esse essa esses essas aquele aquela aqueles aquelas outro outra outros outras algum alguma alguns algumas nenhum nenhuma nenhuns "
    "nenhumas todo toda todos todas muito muita muitos muitas pouco pouca poucos poucas"
).split()

#: Categories in order, each with the keywords that a folded description may contain.
CATEGORIES = {
    "alimentacao": "mercado|supermercado|padaria|restaurante|lanchonete|delivery|ifood|uber eats|rappi",
    "transporte": "uber|99|99pop|taxi|combustivel|posto|onibus|metro|estacionamento|pedagio",
    "saude": "farmacia|hospital|clinica|medico|dentista|laboratorio|exame",
    "educacao": "escola|faculdade|curso|livro|material escolar|ead|treinamento",
    "lazer": "cinema|teatro|show|viagem|hotel|netflix|spotify|lazer",
    "servicos": "aluguel|condominio|luz|energia|agua|agua encanada|gas|internet|telefone|claro|vivo|tim|oi",
    "vestuario": "roupa|sapato|loja|shopping|uniforme",
    "investimento": "aplicacao|aplicacao financeira|poupanca|cdb|tesouro|acao|investimento",
    "Juros/Multa": "multa parcelamento|parcelamento multa|multa|multas|juros de mora|juros mora|juros multa|encargo por atraso|encargos de atraso|encargo mora",
    "transferencia": "ted|doc|pix|transferencia|transferencia enviada|boleto",
    "saque": "saque|caixa eletronico",
    "salario": "salario|ordenado|pagamento",
    "impostos": "darf|das|simples|mei|iss|icms|irpj|csll|pis|cofins|gps|inss|sefaz|prefeitura|taxa|alvara|guia",
    "contabilidade": "contabilidade|contador|escritorio contabil|escritorio contabilidade|honorarios contabeis|balanco",
    "folha_pagamento": "folha|pro labore|prolabore|folha pagamento|fgts|vale refeicao|vale alimentacao|vale transporte|13o|ferias",
    "fornecedores": "fornecedor|fornecedores|compra de materiais|insumos|materiais|mercadoria|estoque|materia-prima|compra|nfe|nf-e|nota fiscal de compra",
    "logistica": "frete|transportadora|correios|sedex|pac|jadlog|loggi|envio|entrega|motoboy|coleta|despacho",
    "marketing": "marketing|publicidade|anuncio|anuncios|ads|facebook ads|google ads|meta ads|instagram ads|linkedin ads|campanha|impulsionamento",
    "tarifas_bancarias": "tarifa|cesta de servicos|manutencao de conta|taxa bancaria|taxa banco|pix tarifa|ted tarifa|doc tarifa|boleto tarifa",
    "assinaturas_saas": "assinatura|subscription|mensalidade|plano|licenca|saas|software|ferramenta|google workspace|microsoft 365|office 365|notion|slack|zoom|github|gitlab",
    "juridico": "juridico|advogado|escritorio advocacia|honorarios juridicos",
    "manutencao": "manutencao|reparo|conserto|assistencia tecnica|suporte tecnico|calibracao",
    "ti": "aws|amazon web services|azure|gcp|google cloud|cloudflare|hospedagem|dominio|registro br|digitalocean|linode|vultr|heroku|railway|servidor|dns",
    "seguros": "seguro|apolice|premio seguro|seguradora|porto seguro|sulamerica|bradesco seguros",
    "equipamentos": "equipamento|impressora|computador|laptop|notebook|teclado|mouse|monitor|hardware|periferico|celular|smartphone|tablet",
    "limpeza": "limpeza|higiene|desinfetante|material de limpeza",
    "escritorio": "papelaria|cartucho|toner|caneta|grampeador|pastas|envelope|impressoes|xerox|copias",
}
#: High-confidence rules in order.
OVERRIDES = {
    "impostos": "darf|das|simples|irpj|csll|pis|cofins|inss|iss|icms|sefaz|prefeitura",
    "tarifas_bancarias": "tarifa|cesta de servicos|manutencao de conta|manutencao",
    "assinaturas_saas": "assinatura|subscription|google workspace|microsoft 365|office 365|notion|slack|zoom|github|gitlab",
    "ti": "aws|azure|gcp|google cloud|cloudflare|dominio|hospedagem|registro br|dns",
    "fornecedores": "fornecedor|insumos|materia-prima|mercadoria|estoque|nfe|nf-e",
    "logistica": "frete|transportadora|correios|sedex|pac|jadlog|loggi|motoboy",
    "contabilidade": "contabilidade|contador|honorarios contabeis",
    "juridico": "juridico|advogado|escritorio advocacia",
    "manutencao": "manutencao|reparo|conserto|assistencia tecnica|calibracao",
    "seguros": "seguro|apolice",
    "escritorio": "papelaria|toner|cartucho|caneta",
    "equipamentos": "impressora|computador|notebook|monitor|teclado|mouse",
    "Juros/Multa": "multa parcelamento|multa|multas|juros de mora|juros mora|juros multa|encargo por atraso|encargos por atraso",
    "folha_pagamento": "prolabore|fgts|13o|13",
}
#: Categories that mean income or expense, folded.
INCOME = "receita|receitas|salario|aporte|pro labore|prolabore|recebimento|entrada|cashback|reembolso recebido".split("|")
EXPENSE = (
    "tarifas bancarias|impostos|fornecedores|marketing|assinaturas saas|contabilidade|juridico|manutencao|ti|folha_pagamento|folha pagamento|lazer|servicos|"
    "saude|transporte|juros/multa|educacao|vestuario|logistica|seguros|equipamentos|limpeza|escritorio|alimentacao"
).split("|")
#: Labels that title case doesn't give.
LABELS = {"folha_pagamento": "Folha de Pagamento", "tarifas_bancarias": "Tarifas Bancarias", "assinaturas_saas": "Assinaturas SaaS", "ti": "TI"}
#: Entity words by type, over folded text.
ENTITIES = {
    "company": r"\b(?:ltda|s\.?a|me|epp|comercio|industria|servicos|importacao|exportacao|distribuidora|supermercado|mercado|loja|restaurante|hotel|clinica|hospital|auto|posto|oficina|mecanica)\b",
    "payment_method": r"\b(?:boleto|ted|doc|pix|debito|credito|cartao|cheque|transferencia|dinheiro|especie|vale)\b",
    "tax": r"\b(?:imposto|taxa|contribuicao|iof|irrf|pis|cofins|csll|iss|icms|ipi)\b",
    "location": r"\b(?:sao|santo|santa|rua|avenida|alameda|travessa|centro|bairro|vila|jardim)\s+[a-z]+",
}


def fold_text(c: Column) -> Column:
    """Lower case, accents stripped, white space runs to one space (X1). Null stays null."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\s+", " ")


def normalize_strict(c: Column) -> Column:
    return F.trim(fold_text(c))


def standard_words(c: Column) -> Column:
    """Words of X3: punctuation to spaces, noise words and words outside 2..50 characters dropped."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(fold_text(c), r"[^a-z0-9_\s]", " "), r"\s+", " ")), " ")
    return F.filter(words, lambda w: F.length(w).between(2, 50) & ~w.isin(NOISE))


def normalize_standard(c: Column) -> Column:
    return F.array_join(standard_words(c), " ")


def normalize_aggressive(c: Column) -> Column:
    """Punctuation removed, noise and one-letter words dropped, first occurrence of each word kept."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(fold_text(c), r"[^a-z0-9_\s]", ""), r"\s+", " ")), " ")
    return F.array_join(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(NOISE))), " ")


def word_count(c: Column) -> Column:
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))


def normalize_confidence(c: Column, mode: str = "standard") -> Column:
    """Words after over words before: as it is for strict, at least 0.1 for aggressive, times 1.2 for standard, 1 at most."""
    norm = {"strict": normalize_strict, "standard": normalize_standard, "aggressive": normalize_aggressive}[mode](c)
    r = F.try_divide(word_count(norm), word_count(c))
    return F.least(F.lit(1.0), r * 1.2 if mode == "standard" else F.greatest(F.lit(0.1), r) if mode == "aggressive" else r)


def entity_list(c: Column, kind: str) -> Column:
    """Sorted distinct entities of a type."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(fold_text(c), F.lit(ENTITIES[kind]), F.lit(0))))


def first_rule(folded: Column, rules: dict[str, str]) -> Column:
    """Name of the first rule with a keyword in the text. The text is bound once, as dozens of inlined copies would overflow generated code."""
    def hits(t: Column) -> Column:
        return F.coalesce(*[F.when(t.rlike(words.replace("-", r"\-")), F.lit(name)) for name, words in rules.items()])

    return F.element_at(F.transform(F.array(folded), hits), 1)


def categorize(description: Column) -> Column:
    """First category with a keyword inside the folded text, else `outros` (X19); keywords match inside words."""
    return F.coalesce(first_rule(fold_text(description), CATEGORIES), F.lit("outros"))


def rule_override(description: Column) -> Column:
    return first_rule(fold_text(description), OVERRIDES)


def canonical_category(c: Column) -> Column:
    return F.when(F.trim(fold_text(c)).isin("multa", "juros/multa", "juros / multa"), F.lit("Juros/Multa")).otherwise(c)


def category_by_sign(amount: Column, category: Column, description: Column) -> Column:
    """An income category on a negative amount, or the reverse, falls back to the rules."""
    category = canonical_category(category)
    folded, back = fold_text(category), F.coalesce(rule_override(description), categorize(description))
    return (
        F.when((amount < 0) & folded.isin(INCOME), F.when(fold_text(back).isin(INCOME), F.lit("outros")).otherwise(back))
        .when((amount > 0) & folded.isin(EXPENSE), F.when(fold_text(back).isin(EXPENSE), F.lit("receitas")).otherwise(back))
        .otherwise(category)
    )


def default_category(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.isNull() | (t == "") | F.lower(t).isin("nan", "none", "null", "n/a", "na"), F.lit("Nao categorizado")).otherwise(t)


def friendly_label(c: Column) -> Column:
    """Fixed labels by snake key, else spaces and title case."""
    d = default_category(c)
    key = F.translate(F.lower(d), "- ", "__")
    fixed = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), list(LABELS.items())[1:], F.when(key == "folha_pagamento", F.lit(LABELS["folha_pagamento"])))
    return F.when(d == "Nao categorizado", d).otherwise(F.coalesce(fixed, F.initcap(F.translate(d, "_-", "  "))))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def entity_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """M3: mean Jaccard over the types present on either side; 0 for none."""
    shares = [F.when((F.size(a[k]) > 0) | (F.size(b[k]) > 0), jaccard(a[k], b[k])) for k in ("company", "payment_method", "tax")]
    total = reduce(lambda x, y: x + y, [F.coalesce(s, F.lit(0.0)) for s in shares])
    n = reduce(lambda x, y: x + y, [s.isNotNull().cast("int") for s in shares])
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def text_similarity(norm_a: Column, norm_b: Column, words_a: Column, words_b: Column, entities: Column) -> Column:
    """M2 on normalised texts: equal 1, contained 0.95, else 0.7 Jaccard of words + 0.3 entity similarity; empty 0."""
    return (
        F.when((norm_a == "") | (norm_b == ""), F.lit(0.0))
        .when(norm_a == norm_b, F.lit(1.0))
        .when(norm_a.contains(norm_b) | norm_b.contains(norm_a), F.lit(0.95))
        .otherwise(F.least(F.lit(1.0), 0.7 * jaccard(words_a, words_b) + 0.3 * entities))
    )


def simple_similarity(a: Column, b: Column) -> Column:
    """Containment 0.8, else 0.6 common words over the longer text's; empty 0."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    wx, wy = F.array_distinct(F.split(x, r"\s+")), F.array_distinct(F.split(y, r"\s+"))
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(x.contains(y) | y.contains(x), F.lit(0.8)).otherwise(0.6 * F.size(F.array_intersect(wx, wy)) / F.greatest(F.size(wx), F.size(wy)))


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two texts, null if either is; for candidates only, as it runs in Python."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def terms(c: Column) -> Column:
    """Words of two or more characters, and pairs of neighbours."""
    def with_pairs(words: Column) -> Column:
        pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.slice(words, i, 2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(words, pairs)

    return bound(with_pairs, F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))


def tfidf_similarity(a: Column, b: Column) -> Column:
    """M4: cosine of TF-IDF over just the two texts: shared terms weigh 1, others 1 + ln 1.5; equal texts 1, empty ones 0."""
    c2 = (1 + 0.4054651081081644) ** 2
    times = lambda xs, t: F.size(F.filter(xs, lambda x: x == t)).cast("double")
    total = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda acc, t: acc + of(t))

    def cosine(ta: Column, tb: Column, both: Column) -> Column:
        dot = total(both, lambda t: times(ta, t) * times(tb, t))
        norm = lambda xs, own: F.sqrt(total(both, lambda t: times(xs, t) * times(xs, t)) + c2 * total(own, lambda t: times(xs, t) * times(xs, t)))
        return F.when(F.size(both) == 0, 0.0).otherwise(dot / (norm(ta, F.array_except(ta, tb)) * norm(tb, F.array_except(tb, ta))))

    counted = bound(lambda ta, tb: bound(cosine, ta, tb, F.array_intersect(ta, tb)), terms(a), terms(b))
    return F.when((F.trim(a) == "") | (F.trim(b) == ""), 0.0).when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1.0).otherwise(counted)


def supplier_name(c: Column) -> Column:
    """The first company entity, else up to three words before LTDA, S.A, ME or EPP and that word; null for none."""
    first = F.regexp_extract(fold_text(c), ENTITIES["company"], 0)
    before = F.regexp_extract(c, r"(?i)((?:\S+\s+){0,3}(?:LTDA|S\.A|ME|EPP))(?=\s|$)", 1)
    return F.when(first != "", first).when(before != "", before)
