"""All core queries and their SQL, by name."""

from telar.plans import analytics, governance, grounding, problems, records, relational, reports, reviews, scalars, streams

MODULES = [problems, scalars, relational, analytics, governance, reports, records, grounding, reviews, streams]

# DuckDB's sums of integers and products of decimals are wider than the queries' types.
WIDER = {
    "q04_dato_oficial": {"nulos": "BIGINT"}, "a03_conteo_condicionado": {"letras": "BIGINT"}, "a27_histograma": {"desde_3": "BIGINT"}, "a31_mayor_con_desempate": {"n3": "BIGINT"},
    "e02_por_clase": {"tp": "BIGINT", "fp": "BIGINT", "fn": "BIGINT"}, "e19_auc": {"positives": "BIGINT", "negatives": "BIGINT"},
    "e10_barrido": {"threshold": "DOUBLE", "tp": "BIGINT", "fp": "BIGINT"}, "e13_umbral_de_margen": {"errors": "BIGINT"}, "val01_reglas_de_fila": {"broken": "BIGINT"},
    "f42_numeros_en_palabras": {"suma": "DOUBLE"}, "f44_mcnemar": {"b": "BIGINT", "c": "BIGINT"}, "e14_por_mitades": {"calla_bien": "BIGINT", "calla_mal": "BIGINT", "habla_mal": "BIGINT"},
    "z103_leyenda_de_alcance": {"con_leyenda": "BIGINT"}, "z078_ganador_por_consulta": {"ia": "BIGINT", "base": "BIGINT"}, "e07_consultas_falladas": {"faltan": "BIGINT"},
    "e13_regla_percentil": {"tp": "BIGINT", "fp": "BIGINT", "fn": "BIGINT"}, "e22_umbral_por_pliegues": {"threshold": "DOUBLE"}, "z106_predicciones": {"aciertos": "BIGINT"},
    "z058_enlaces": {"visibles": "BIGINT", "ocultos": "BIGINT"}, "z091_hoja_de_seleccion": {"repetidas": "BIGINT", "ajenas": "BIGINT"}, "z040_limites_del_catalogo": {"sin_magnitud": "BIGINT"},
    "z033_reparto_de_temas": {"iguales": "BIGINT"}, "z026_estimacion_de_terminos": {"aciertos": "BIGINT"},
}


def _typed(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c, kind in WIDER.get(name, {}).items())
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql


QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: _typed(name, sql) for module in MODULES for name, sql in module.ORACLE.items()}
