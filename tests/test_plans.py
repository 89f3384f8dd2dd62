"""Parsing, checks, rewrites, stages and costs: no Spark needed."""

import pytest

from tomoflow.functions import numbers
from tomoflow.methods import REQUIRED, bind, known, spec
from tomoflow.plans import check as checks
from tomoflow.plans import cost, preview, rules, stages
from tomoflow.plans.model import Pipeline, Preview, Ref, Step, Sweep, Window
from tomoflow.plans.parse import PipelineError, build, load_json, load_yaml, parse, reference

HEAD = "- {method: standard_tomo, module_path: tomoflow.loaders, parameters: {}}\n"


def steps(*names, **patterns):
    return tuple(Step(n, f"m.{n}", pattern=spec(n).pattern, padded=spec(n).padding({})) for n in names)


# numbers


@pytest.mark.parametrize(("text", "n"), [("512", 512), ("1k", 1024), ("1.5M", 1572864), ("2g", 2 << 30), (" 3G ", 3 << 30)])
def test_byte_size(text, n):
    assert numbers.byte_size(text) == n


def test_byte_size_rejects_text():
    with pytest.raises(ValueError):
        numbers.byte_size("many")


@pytest.mark.parametrize(("n", "want"), [(1, 1), (2, 2), (3, 4), (1024, 1024), (1025, 2048)])
def test_next_power_of_two(n, want):
    assert numbers.next_power_of_two(n) == want


def test_ranges():
    assert numbers.arange(0, 10, 3) == [0, 3, 6, 9] and numbers.arange(5, 1, -2) == [5, 3] and numbers.arange(3, 3, 1) == []
    assert numbers.linspace(0, 180, 3) == [0, 90, 180] and numbers.linspace(5, 9, 1) == [5]
    assert numbers.bounds(10, 4) == [0, 2, 5, 8, 10]  # halves go to the even number


# previews


@pytest.mark.parametrize(("n", "want"), [(1, (0, 1)), (2, (0, 2)), (3, (0, 3)), (4, (0, 3)), (5, (1, 3)), (10, (3, 6)), (11, (4, 6))])
def test_middle(n, want):
    assert preview.middle(n) == want


@pytest.mark.parametrize(
    ("entry", "n", "want"),
    [
        (None, 9, (0, 9)),
        ({"start": 2}, 9, (2, 9)),
        ({"start": "begin", "stop": "end"}, 9, (0, 9)),
        ({"start": "mid"}, 10, (4, 10)),
        ({"start": "mid"}, 9, (4, 9)),
        ({"start": 3, "start_offset": -5}, 9, (0, 9)),
        ({"stop": 8, "stop_offset": 5}, 9, (0, 9)),
        ({"start": 2, "start_offset": 1, "stop": 8, "stop_offset": -2}, 9, (3, 6)),
        ("mid", 10, (3, 6)),
    ],
)
def test_windows(entry, n, want):
    w = preview.window(entry, n)
    assert (w.start, w.stop) == want


@pytest.mark.parametrize(
    "entry",
    [{"angles": "mid"}, {"detector_y": {"start": 5, "stop": 5}}, {"detector_y": {"stop": 99}}, {"detector_x": {"start": "centre"}}, {"rows": None}, {"detector_x": {"start": -1}}],
)
def test_previews_out_of_bounds(entry):
    with pytest.raises(ValueError):
        preview.parse_preview(entry, (10, 10, 10))


def test_subset_replaces_angles():
    p = preview.parse_preview({"angles": {"start": 1, "stop": 3}}, (10, 10, 10))
    assert preview.continuous_subset(p, {"start": 4, "stop": 9}).angles == Window(4, 9)
    assert preview.continuous_subset(p, None) == p


@pytest.mark.parametrize(("start", "stop", "want"), [(0, 128, (62, 66)), (10, 15, (10, 15)), (10, 16, (11, 15)), (0, 5, (0, 5)), (0, 2, (0, 3)), (125, 128, (124, 128))])
def test_sweep_preview(start, stop, want):
    whole = Window(0, 10)
    got = preview.sweep_preview(Preview(whole, Window(start, stop), whole), 128).detector_y
    assert (got.start, got.stop) == want


def test_sweep_needs_rows():
    with pytest.raises(ValueError):
        preview.sweep_preview(Preview(Window(0, 1), Window(0, 4), Window(0, 1)), 4)


def test_angles_and_frames():
    assert preview.parse_angles({"data_path": "/a"}).path == "/a"
    assert preview.parse_angles({"user_defined": {"start_angle": 0, "stop_angle": 180, "angles_total": 3}}).n == 3
    with pytest.raises(ValueError):
        preview.parse_angles({})
    here = preview.Frames("", "data", "key")
    assert preview.parse_frames(None, here) == here and preview.parse_frames("ignore", here) is None
    assert preview.parse_frames({"input_data": "f", "data_path": "d"}, here) == preview.Frames("f", "d", None)
    with pytest.raises(ValueError):
        preview.parse_frames({"data_path": "d"}, here)


def test_calibration_plan():
    a, b, c = preview.Frames("", "d", "k"), preview.Frames("f", "d"), preview.Frames("", "e", "k")
    plan = preview.calibration_plan
    assert plan(None, None) == ("dummy", "dummy") and plan(None, a) == ("dummy", "separate") and plan(a, None) == ("separate", "dummy")
    assert plan(a, b) == ("separate", "separate") and plan(a, c) == ("separate", "separate") and plan(a, a) == ("together", "together")
    with pytest.raises(ValueError):
        plan(None, preview.Frames("", "d"))


def test_distortion_coefficients():
    assert preview.distortion_coefficients("xcenter = 1.5\nycenter = 2\nfactor0 = 1.0\nfactor1 = 1e-3\n\n") == (1.5, 2.0, [1.0, 1e-3])
    with pytest.raises(ValueError):
        preview.distortion_coefficients("a = 1\n")


# parsing

LINKED = HEAD + (
    "- {method: find_center_vo, module_path: m.rotation, parameters: {}, id: centering, side_outputs: {cor: centre}}\n"
    '- {method: FBP, module_path: m.algorithm, parameters: {center: "${{centering.side_outputs.centre}}"}}\n'
)


def test_references_and_defaults():
    p = parse(LINKED)
    assert p.steps[1].parameters["center"] == Ref("centering", "centre")
    assert p.steps[1].save_result and not p.steps[0].save_result and p.steps[1].pattern == "sinogram"


@pytest.mark.parametrize(
    "text",
    [
        LINKED.replace("side_outputs.centre", "side_outputs.other"),
        LINKED.replace("${{centering", "${{nowhere"),
        LINKED.replace("centering.side_outputs.centre", "centering.centre"),
        LINKED.replace("tomoflow.loaders", "tomoflow.other"),
        LINKED + "- {method: minus_log, module_path: m, parameters: {}, id: centering, side_outputs: {}}\n",
        "",
    ],
)
def test_pipelines_that_cannot_be_built(text):
    with pytest.raises(PipelineError):
        build(load_yaml(text))


def test_reference_is_not_any_text():
    assert reference("a.b") is None and reference(3) is None and reference("${{a.side_outputs.b}}") == ("a", "b")


def test_sweeps():
    p = parse(HEAD + "- {method: median_filter, module_path: m, parameters: {size: !Sweep [1, 3, 5]}}\n")
    assert p.sweeps[0].sweep == ("size", Sweep((1, 3, 5)))
    p = parse(HEAD + "- {method: median_filter, module_path: m, parameters: {size: !SweepRange {start: 1, stop: 7, step: 2}}}\n")
    assert p.sweeps[0].sweep[1].values == (1, 3, 5)


def test_json():
    text = '[{"method": "l", "module_path": "x.loaders"}, {"method": "median_filter", "module_path": "m", "parameters": {"size": [1, 3]}}]'
    assert not parse(text).sweeps and parse(text, lists_are_sweeps=True).sweeps[0].sweep[1].values == (1, 3)
    swept = load_json('[{"parameters": {"a": {"sweep": [1, 2]}, "b": {"sweep_range": {"start": 0, "stop": 3, "step": 1}}}}]')
    assert swept[0]["parameters"] == {"a": Sweep((1, 2)), "b": Sweep((0, 1, 2))}


# checks

GOOD = LINKED.replace("parameters: {}}\n- {method: find", "parameters: {}}\n- {method: find")


def failed(text):
    return {f.rule for f in checks.check(text) if not f.ok}


def test_good_pipeline_passes():
    assert checks.passes(GOOD)


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        ("- [1", "syntax"),
        ("a: 1", "syntax"),
        (HEAD + "- {method: minus_log, method: minus_log, module_path: m, parameters: {}}\n", "duplicate_key"),
        ("- {method: minus_log, module_path: m, parameters: {}}\n", "loader_first"),
        (HEAD + "- {method: nothing, module_path: m, parameters: {}}\n", "method_exists"),
        (HEAD + "- {method: minus_log, module_path: m, parameters: {flor: 1}}\n", "parameter_known"),
        (HEAD + "- {method: distortion_correction_proj, module_path: m, parameters: {xcenter: 1, ycenter: 2}}\n", "required_given"),
        (HEAD + "- {method: minus_log, module_path: m, parameters: {1: 2}}\n", "names_text"),
        (HEAD + "- {method: minus_log, module_path: m, parameters: {floor: REQUIRED}}\n", "no_required_left"),
        (HEAD + "- {method: median_filter, module_path: m, parameters: {size: !Sweep [1, 3]}}\n- {method: save_to_images, module_path: m, parameters: {}}\n", "no_images_after_sweep"),
        (HEAD + "- {method: minus_log, module_path: m}\n", "keys"),
        (HEAD + "- {method: minus_log, module_path: m, parameters: {}, id: a}\n", "id_side_outputs"),
        (LINKED + "- {method: minus_log, module_path: m, parameters: {}, id: centering, side_outputs: {}}\n", "id_unique"),
        (LINKED.replace("${{centering", "${{nowhere"), "reference_id"),
        (LINKED.replace("side_outputs.centre", "side_outputs.other"), "reference_name"),
        (LINKED.replace("centering.side_outputs.centre", "centering.centre"), "reference_form"),
        (HEAD + "- {method: median_filter, module_path: m, parameters: {size: !Sweep [1, 3]}}\n" * 2, "one_sweep"),
        (HEAD + "- {method: median_filter, module_path: m, parameters: {size: !Sweep [1, 3]}, id: a, side_outputs: {b: c}}\n", "sweep_no_side_outputs"),
        (HEAD + "- {method: seam_blend_stitched_data, module_path: m, parameters: {seam_index: 3}}\n", "seam_order"),
    ],
)
def test_every_rule_fires(text, rule):
    assert rule in failed(text)


def test_paths_are_checked():
    text = "- {method: standard_tomo, module_path: tomoflow.loaders, parameters: {data_path: nothing, image_key_path: auto}}\n"
    assert not checks.passes(text, ["embedding"]) and checks.passes(text.replace("nothing", "embedding"), ["embedding"])


# rewrites


def names(pipeline):
    return [s.method for s in pipeline.steps]


def test_rewrite_of_a_full_run():
    p = Pipeline(Step("l", "x.loaders"), steps("normalize", "find_center_vo", "FBP", "calculate_stats", "save_to_images"))
    p = Pipeline(p.loader, tuple(s if s.method != "FBP" else Step("FBP", "m.algorithm", pattern="sinogram", save_result=True) for s in p.steps))
    got = rules.rewrite(p)
    assert names(got) == ["data_reducer", "normalize", "data_checker", "find_center_vo", "data_checker", "FBP", "save_intermediate_data", "data_checker", "calculate_stats", "save_to_images"]
    everything = names(rules.rewrite(p, save_all=True))
    assert everything.count("save_intermediate_data") == 4 and "center" not in "".join(s.parameters.get("of", "") for s in rules.rewrite(p, save_all=True).steps)


def test_rewrite_of_a_sweep():
    swept = Step("median_filter", "m.corr", {"size": Sweep((1, 3))})
    p = Pipeline(Step("l", "x.loaders"), (*steps("calculate_stats"), swept, Step("FBP", "m.recon.algorithm"), *steps("rescale_to_int", "save_to_images")))
    assert names(rules.rewrite(p)) == ["data_reducer", "median_filter", "save_to_images", "data_checker", "FBP", "save_to_images"]


def test_defaults_are_filled():
    got = rules.fill_defaults(steps("minus_log", "distortion_correction_proj"))
    assert got[0].parameters == {"floor": 1e-6} and "xcenter" not in got[1].parameters and REQUIRED not in got[1].parameters.values()


# stages


def plan(*names_, loader="all"):
    pattern, out = stages.plan_stages(Pipeline(Step("l", "x.loaders"), steps(*names_)), loader)
    return pattern, [(s.pattern, [x.method for x in s.steps]) for s in out]


def test_stages_change_with_the_pattern():
    assert plan("normalize", "minus_log", "FBP") == ("projection", [("projection", ["normalize", "minus_log"]), ("sinogram", ["FBP"])])


def test_open_stages_take_the_next_pattern():
    assert plan("minus_log", "FBP") == ("sinogram", [("sinogram", ["minus_log", "FBP"])])
    assert plan("minus_log", "calculate_stats") == ("projection", [("projection", ["minus_log", "calculate_stats"])])


def test_no_empty_first_stage():
    assert plan("FBP", loader="projection")[1] == [("sinogram", ["FBP"])]


def test_second_halo_splits():
    _, got = plan("median_filter3d", "mean_filter3d")
    assert [m for _, m in got] == [["median_filter3d"], ["mean_filter3d"]]
    _, out = stages.plan_stages(Pipeline(Step("l", "x.loaders"), steps("median_filter3d")))
    assert out[0].padding == (1, 1) and out[-1].last


def test_needed_values_split():
    first = Step("calculate_stats", "m", id="s", side_outputs={"glob_stats": "g"})
    second = Step("rescale_to_int", "m", {"glob_stats": Ref("s", "g")})
    _, out = stages.plan_stages(Pipeline(Step("l", "x.loaders"), (first, second)))
    assert [len(s.steps) for s in out] == [1, 1]


def test_image_axis_sets_the_pattern():
    image = Step("save_to_images", "m.images", {"axis": 1})
    _, out = stages.plan_stages(Pipeline(Step("l", "x.loaders"), (*steps("minus_log"), image)))
    assert out[0].pattern == "sinogram" and all(s.pattern == "sinogram" for s in out[0].steps)


def named(name, pattern="all", **more):
    return Step(name, f"m.{name}", pattern=pattern, **more)


def staged(*steps_, loader="all"):
    return [(s.pattern, [x.method for x in s.steps]) for s in stages.plan_stages(Pipeline(Step("l", "x.loaders"), steps_), loader)[1]]


def test_open_steps_keep_the_layout_they_find():
    assert staged(named("a", "sinogram"), named("b"), named("c")) == [("sinogram", ["a", "b", "c"])]
    assert staged(named("a"), named("b", "sinogram"), loader="projection") == [("projection", ["a"]), ("sinogram", ["b"])]
    needs = named("b", parameters={"v": Ref("a", "x")})
    assert staged(named("a", "sinogram", id="a"), needs) == [("sinogram", ["a"]), ("sinogram", ["b"])]
    assert staged(named("a", id="a"), needs, named("c", "sinogram")) == [("sinogram", ["a"]), ("sinogram", ["b", "c"])]


def test_a_value_from_an_earlier_stage_splits_nothing():
    late = named("c", "sinogram", parameters={"v": Ref("a", "x")})
    assert staged(named("a", "projection", id="a"), named("b", "sinogram"), late) == [("projection", ["a"]), ("sinogram", ["b", "c"])]


def test_image_axis_changes_its_own_stage_only():
    image = Step("save_to_images", "m.images", {"axis": 1})
    assert staged(named("a", "projection"), image, named("b", "projection", id="b"), named("c", parameters={"v": Ref("b", "x")})) == [
        ("sinogram", ["a", "save_to_images", "b"]),
        ("projection", ["c"]),
    ]
    assert staged() == [("projection", [])]


def test_the_last_stage_is_marked():
    out = stages.plan_stages(Pipeline(Step("l", "x.loaders"), (named("a", "projection"), named("b", "sinogram"), named("c", "projection"))))[1]
    assert [s.last for s in out] == [False, False, True]


def test_sweep_stages():
    swept = Step("median_filter", "m", {"size": Sweep((1, 3))})
    p = Pipeline(Step("l", "x.loaders"), (*steps("normalize"), swept, *steps("minus_log")))
    got = stages.sweep_stages(p)
    assert (got.parameter, got.values) == ("size", (1, 3)) and [s.method for s in got.before + got.after] == ["normalize", "minus_log"]
    for bad in (steps("normalize"), (swept, swept), (Step("m", "m", {"a": Sweep((1,)), "b": Sweep((2,))}),), (Step("m", "m", {"a": Sweep((1, 2))}, side_outputs={"x": "y"}),)):
        with pytest.raises(ValueError):
            stages.sweep_stages(Pipeline(p.loader, bad))


# costs


def test_costs():
    assert cost.input_share((10, 8, 6), 0, 4, 1) == (3, 8, 6) and cost.input_share((10, 8, 6), 1, 2, 0, (1, 1)) == (10, 6, 6)
    _, out = stages.plan_stages(Pipeline(Step("l", "x.loaders"), steps("normalize", "FBP")))
    one = cost.stage_memory(out, 0, (10, 8, 6), 1)
    assert one.total == 2 * 10 * 8 * 6 * 4 and one.moved_bytes == 10 * 8 * 6 * 4
    assert cost.stage_memory(out, 0, (10, 8, 6), 2).moved_bytes == one.moved_bytes and cost.shuffle_partitions((128 << 20) + 1) == 2
    assert cost.peak_memory(out, (10, 8, 6), 2) > 0
    assert cost.slices_per_batch(out[0], 100, None, 1000) == 64 and cost.slices_per_batch(out[0], 100, 30_000, 1000) * 300 <= 30_000


# binding


def test_binding():
    def method(data, theta, axis, size=3, *, extra=1):
        return data

    assert bind(method, {"axis": "auto"}, {"theta": 1}, "sinogram") == {"theta": 1, "axis": 1}
    assert bind(method, {"axis": 0, "size": 5}, {"theta": 1}, "sinogram") == {"theta": 1, "axis": 0, "size": 5}
    with pytest.raises(ValueError):
        bind(method, {"other": 1}, {"theta": 1}, "sinogram")
    with pytest.raises(ValueError):
        bind(method, {}, {}, "sinogram") if False else bind(lambda data, needed: data, {}, {}, "projection")
    assert bind(lambda data, **rest: data, {"a": 1}, {}, "projection") == {"a": 1}


def test_registry():
    assert known("FBP") and not known("nothing") and spec("nothing").any_parameter
