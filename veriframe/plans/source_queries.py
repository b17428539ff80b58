"""A query for each source check: suppliers stand for files, by turns with each of a check's texts.

Every check has a faulty and a clean text, and some have more; the SQL side knows which supplier has which, and on what
lines and columns the issues are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import source


@dataclass(frozen=True)
class Example:
    bad: str
    good: str
    issues: int = 1
    options: dict[str, Any] = field(default_factory=dict)
    file: str = "lib/app/file{n}.ex"
    good_file: str | None = None


def _m(body: str, name: str = "App.Posts") -> str:
    return f"defmodule {name} do\n{body}\nend\n"


def _f(body: str, head: str = "run(x)") -> str:
    return _m(f"  def {head} do\n{body}\n  end")


def _h(markup: str) -> str:
    return _m(f'  def page(assigns) do\n    ~H"""\n    {markup}\n    """\n  end')


_LIVE = "  use Phoenix.LiveView\n"
_TEST = "lib/app/file{n}_test.exs"
_ROUTES = {"web_paths": ["lib/app_web/"], "fallback_router_paths": ["/posts/:id", "/about"]}

EXAMPLES: dict[str, Example] = {
    "ecto.composable_preload_queries": Example(_m("  def with_author_preload_query(q), do: preload(q, [:author])"), _m("  def with_author_preload_query(q, preloads), do: preload(q, ^preloads)")),
    "ecto.context_owns_schema_queries": Example(_m("  alias App.Blog.Post\n  def all, do: Repo.all(Post)", "App.Shop"), _m("  alias App.Blog.Post\n  def all, do: Repo.all(Post)", "App.Blog"), options={"contexts": ["App.Blog", "App.Shop"]}),
    "ecto.error_changeset_pattern_match": Example(_f("    case x do\n      {:error, changeset} -> changeset\n      {:ok, y} -> y\n    end"), _f("    case x do\n      {:error, %Ecto.Changeset{} = changeset} -> changeset\n      {:ok, y} -> y\n    end")),
    "ecto.named_binding": Example(_f("    x |> where([u], u.id == 1)\n    Post |> where(id: 1)"), _f("    x |> where([post: p], p.id == 1)"), 2),
    "ecto.no_and_in_where": Example(_f("    where(x, [p], p.a == 1 and p.b == 2)\n    from(p in Post, where: p.a == 1 and p.b == 2)"), _f("    x |> where([p], p.a == 1) |> where([p], p.b == 2 or p.c == 3)"), 2),
    "ecto.no_data_changes_in_schema_migrations": Example(_f('    Repo.update_all(Post, set: [a: 1])\n    execute("-- note\\n  UPDATE posts SET a = 1")', "change()"), _f('    execute("CREATE INDEX i ON posts (a)")', "change()"), 2, file="priv/repo/migrations/{n}.exs"),
    "ecto.no_repo_preload_after_query": Example(_f("    Post |> Repo.all() |> Repo.preload(:author)\n    y = Repo.one(x)\n    Repo.preload(y, :author)"), _f("    x |> preload(:author) |> Repo.all()\n    Repo.preload(x, :author)"), 2),
    "ecto.no_repo_transaction": Example(_f("    Repo.transaction(fn -> x end)"), _f("    Repo.transact(fn -> x end)")),
    "ecto.own_context_for_schema": Example(_m("  use App.Schema", "App.Posts.Invoice"), _m("  use App.Schema", "App.Posts.PostTag"), options={"schema_modules": ["App.Schema"]}),
    "ecto.pipe_based_queries": Example(_f("    from(p in Post, where: p.id == ^x, select: p)"), _f("    from(p in Post, as: :post)")),
    "ecto.prefer_datetime_over_date": Example(_m('  schema "posts" do\n    field :day, :date\n    field :at, :utc_datetime\n  end'), _m('  schema "posts" do\n    field :at, :utc_datetime\n  end')),
    "ecto.prefer_order_by_over_repo_all_enum_sort": Example(_f("    x |> Repo.all() |> Enum.sort_by(& &1.id)\n    Enum.sort(Repo.all(x))"), _f("    x |> Repo.all() |> Enum.sort(:desc)\n    x |> Enum.sort()"), 2),
    "ecto.prefer_repo_aggregate_count": Example(_f("    x |> Repo.all() |> Enum.count()\n    length(Repo.all(x))\n    Repo.aggregate(x, :count) > 0"), _f("    Repo.aggregate(x, :count) > 5\n    Enum.count(x)"), 3),
    "ecto.prefer_repo_one_over_all_first": Example(_f("    x |> Repo.all() |> List.first()\n    hd(Repo.all(x))\n    x |> Repo.all() |> Enum.at(0)"), _f("    x |> Repo.all() |> Enum.at(1)\n    Repo.one(x)"), 3),
    "ecto.prefer_select_over_repo_all_enum_map": Example(_f("    x |> Repo.all() |> Enum.map(& &1.id)\n    Enum.map(Repo.all(x), fn p -> p.title end)"), _f("    x |> Repo.all() |> Enum.map(&work/1)\n    x |> Repo.all() |> Enum.map(fn p -> String.upcase(p.title) end)"), 2),
    "ecto.use_my_app_schema": Example(_m("  use Ecto.Schema"), _m("  use App.Schema")),
    "elixir.app_module_acronym_casing": Example(_m("  alias App.HttpClient\n  alias Other.HttpClient"), _m("  alias App.HTTPClient"), options={"app_roots": ["App"]}),
    "elixir.doc_before_spec": Example(_m('  @spec run(x :: term()) :: term()\n  @doc "Runs."\n  def run(x), do: x'), _m('  @doc "Runs."\n  @spec run(x :: term()) :: term()\n  def run(x), do: x')),
    "elixir.filter_reject_first": Example(_f("    x |> Enum.filter(&ok?/1) |> List.first()\n    List.first(Enum.reject(x, &ok?/1))"), _f("    Enum.find(x, &ok?/1)\n    List.first(x)"), 2),
    "elixir.float_usage": Example(_f("    Float.round(x, 2)\n    y = 1.5"), _f("    Decimal.round(x, 2)"), 2),
    "elixir.fully_specified_struct_types": Example(_m("  @type t :: %__MODULE__{}"), _m("  @type t :: %__MODULE__{id: integer()}")),
    "elixir.fully_typed_opts": Example(_m("  @type run_opts :: Keyword.t()\n  @spec run(opts :: keyword()) :: :ok"), _m("  @type run_opts :: [run_opt()]\n  @spec run(opts :: run_opts()) :: :ok"), 2),
    "elixir.named_spec_params": Example(_m("  @spec run(integer(), y :: term()) :: :ok"), _m("  @spec run(x :: integer()) :: :ok\n  @spec now() :: integer()")),
    "elixir.no_catch_all_in_with_else": Example(_f("    with {:ok, y} <- x do\n      y\n    else\n      error -> error\n    end"), _f("    with {:ok, y} <- x do\n      y\n    else\n      {:error, reason} -> reason\n    end")),
    "elixir.no_end_of_day_time": Example(_f("    DateTime.new(x, ~T[23:59:59.999])"), _f("    DateTime.new(x, ~T[00:00:00])")),
    "elixir.no_extra_public_behaviour_functions": Example(_m("  @behaviour Worker\n  def run(x), do: x\n  def help, do: 1\n  defp own, do: 1"), _m("  @behaviour Worker\n  def run(x), do: x"), options={"behaviours": {"Worker": [("run", 1)]}}),
    "elixir.no_low_level_process_primitives": Example(_f("    Process.sleep(1)\n    GenServer.call(x, :y)\n    :ets.lookup(:t, x)"), _f("    Worker.call(x)"), 3),
    "elixir.no_param_extraction_in_function_head": Example(_f("    fn %{id: id} -> id end", "run(%{name: name})"), _f("    x", "run(%{kind: :a, n: n} = x) when n > 0"), 2),
    "elixir.no_passthrough_wrapper": Example(_m("  defp wrap(a, b), do: Other.call(a, b)\n  def run(a), do: wrap(a, 1)"), _m("  defp wrap(a, b), do: Other.call(b, a)\n  def run(a), do: wrap(a, 1)")),
    "elixir.no_raise": Example(_f('    raise "no"\n    Repo.get!(Post, x)\n    {:ok, y} = fetch(x)'), _f("    y = fetch(x)\n    {a, b} = y"), 3),
    "elixir.no_remote_calls_in_module_attributes": Example(_m("  @limit App.Config.limit()"), _m("  @limit String.length(\"abc\")\n  @fun fn -> App.Config.limit() end")),
    "elixir.no_result_tuple_argument": Example(_m("  def run({:ok, x}, y), do: {x, y}"), _m("  def run(y, {:ok, x}), do: {x, y}")),
    "elixir.no_then": Example(_f("    x |> then(&work/1)\n    then(x, &work/1)"), _f("    work(x)"), 2),
    "elixir.no_try_rescue": Example(_f("    try do\n      x\n    rescue\n      e -> e\n    end"), _f("    try do\n      x\n    after\n      done()\n    end")),
    "elixir.prefer_block_if": Example(_f("    if x, do: 1, else: 2"), _f("    if x do\n      1\n    else\n      2\n    end")),
    "elixir.prefer_empty_list_checks": Example(_f("    x == []\n    [] != x"), _f("    Enum.empty?(x)"), 2),
    "elixir.prefer_enum_count": Example(_f("    length(x)\n    x |> Kernel.length()"), _f("    Enum.count(x)", "run(x) when length(x) > 1"), 2),
    "elixir.prefer_enum_uniq_by": Example(_f("    x |> Enum.map(& &1.id) |> Enum.uniq()"), _f("    x |> Enum.map(&work/1) |> Enum.uniq()")),
    "elixir.prefer_list_type_syntax": Example(_m("  @type ids :: [integer()]"), _m("  @type ids :: list(integer())\n  @type some :: [integer(), ...]\n  @type f :: [a: integer()]")),
    "elixir.reject_count": Example(_f("    x |> Enum.reject(&ok?/1) |> Enum.count()"), _f("    x |> Enum.filter(&ok?/1) |> Enum.count()")),
    "elixir.simple_tagged_tuple_values": Example(_f("    {:ok, work(x)}\n    {:cont, {:ok, %{a: 1}}}"), _f("    {:ok, x}\n    {:cont, {:ok, x, 1}}\n    {x, work(x)}"), 2),
    "elixir.use_maybe_in_function_name": Example(_m("  def load_if_needed(x), do: x\n  def load_if_needed(y), do: y"), _m("  def maybe_load(x), do: x")),
    "elixir.with_else_clause": Example(_f("    with {:ok, y} <- x do\n      y\n    end"), _f("    with {:ok, y} <- x do\n      y\n    else\n      {:error, e} -> e\n    end")),
    "heex.no_duplicate_static_ids": Example(_h('<p id="a"></p><p id="a"></p><p id={@x}></p><p id={@x}></p>'), _h('<p id="a"></p><p id="b"></p>')),
    "heex.no_element_spacing": Example(_h('<p class="mt-2 md:!-mx-4 mx-auto flex"></p>'), _h('<p class="gap-2 mx-auto p-4"></p>'), 2),
    "heex.no_indirect_assign_access": Example(_h("<p>{Map.get(assigns, :x)}</p><p id={assigns[:y]}></p>"), _h("<p>{@x}</p>"), 2),
    "heex.no_javascript_href": Example(_h('<a href=" JavaScript:void(0)">x</a>'), _h('<a href="/javascript:">x</a>')),
    "heex.prefer_link_for_navigation": Example(_h('<div phx-click={JS.navigate("/x")}></div>'), _h('<.link phx-click={JS.navigate("/x")}>x</.link><div phx-click={JS.push("x")}></div>')),
    "heex.prefer_native_interactive_element": Example(_h('<div phx-click="x"></div>'), _h('<div phx-click="x" role="button" tabindex="0" phx-keydown="x"></div>')),
    "heex.require_accessible_button_text": Example(_h("<button><i></i></button>"), _h('<button>{@x}</button><button aria-label="x"><i></i></button>')),
    "heex.require_button_type": Example(_h("<button>x</button>"), _h('<button type="button">x</button><button {@rest}>x</button>')),
    "heex.require_image_alt": Example(_h('<img src="x">'), _h('<img src="x" alt=""><img {@rest}>')),
    "heex.require_label_for_input": Example(_h('<input id="a"><select></select>'), _h('<label for="a">A</label><input id="a"><input type="hidden"><input id={@x}>'), 2),
    "heex.require_link_href": Example(_h("<a>x</a>"), _h('<a href="/">x</a><a {@rest}>x</a>')),
    "heex.require_link_text": Example(_h('<a href="/"><i></i></a>'), _h('<a href="/"><img alt="Home" src="x"></a><a href="/">x</a>')),
    "heex.require_loading_state_for_submit": Example(_h('<form phx-submit="s"><button type="submit">x</button></form><form phx-submit="s"></form>'), _h('<form phx-submit="s"><button type="submit" phx-disable-with="...">x</button></form>'), 2),
    "heex.require_target_blank_rel": Example(_h('<a target="_blank" href="/">x</a>'), _h('<a target="_blank" rel="noreferrer NoOpener" href="/">x</a>')),
    "heex.design_system.no_arbitrary_spacing": Example(_h('<p class="md:-mt-[3px] w-[3px]" style="padding-top: 4px; width: 3px"></p>'), _h('<p class="mt-[1rem] p-2" style="padding: 1rem"></p>'), 2),
    "phoenix.context_function_naming": Example(_m("  @spec get_a(id :: integer()) :: {:ok, term()} | {:error, term()}\n  @spec fetch_b(id :: integer()) :: {:ok, term()} | nil\n  @spec get_c!(id :: integer()) :: term() | nil"), _m("  @spec get_a(id :: integer()) :: A.t() | nil\n  @spec fetch_b(id :: integer()) :: {:ok, term()} | {:error, term()}\n  @spec get_c!(id :: integer()) :: C.t()"), 3),
    "phoenix.no_repo_in_controller": Example(_f("    App.Repo.all(x)"), _f("    App.Posts.all(x)"), file="lib/app_web/file{n}_controller.ex"),
    "phoenix.uri_decode_query": Example(_f("    URI.decode_query(x)"), _f("    Plug.Conn.Query.decode(x)")),
    "phoenix.use_verified_routes": Example(_f('    x |> get("/posts/#{x.id}")\n    redirect(x, to: "/about?a=1")'), _f('    x |> get(~p"/posts/#{x.id}")\n    redirect(x, to: "/other")\n    get(x, "/posts/{id}")'), 2, _ROUTES, "lib/app_web/file{n}.ex"),
    "phoenix_live_view.no_inline_assign_in_return_tuple": Example(_m(_LIVE + "  def handle_event(_, _, socket), do: {:noreply, assign(socket, :a, 1)}\n  def handle_info(_, socket), do: {:noreply, socket |> assign(:a, 1) |> push()}"), _m(_LIVE + "  def handle_info(_, socket) do\n    socket = assign(socket, :a, 1)\n    {:noreply, socket}\n  end"), 2),
    "phoenix_live_view.require_explicit_connection_state_handling_in_mount": Example(_m(_LIVE + "  def mount(p, s, socket), do: {:ok, socket}"), _m(_LIVE + "  def mount(p, s, socket) do\n    if connected?(socket) do\n      mount_connected(p, s, socket)\n    else\n      mount_disconnected(p, s, socket)\n    end\n  end")),
    "phoenix_live_view.require_function_component_attrs": Example(_m('  attr :a, :string\n  def card(assigns) do\n    ~H"""\n    <p id={@b}>{@a}</p>\n    """\n  end'), _m('  attr :a, :string\n  slot :b\n  def card(assigns) do\n    assigns = assign(assigns, :c, 1)\n    ~H"""\n    <p id={@c}>{@a}{@b}</p>\n    """\n  end')),
    "testing.no_describe_blocks": Example(_m('  use ExUnit.Case\n  describe "x" do\n    test "y" do\n      assert true\n    end\n  end'), _m('  use ExUnit.Case\n  test "y" do\n    assert true\n  end'), file=_TEST),
    "testing.no_global_state_in_tests": Example(_f('    Application.put_env(:app, :k, x)\n    System.get_env("A")'), _f("    Application.start(:app)"), 2, file=_TEST),
    "testing.no_setup_in_tests": Example(_m("  setup do\n    :ok\n  end\n  setup_all :x"), _m("  setup :verify_on_exit!"), 2, file=_TEST),
    "testing.no_tests_in_test_dir": Example("1", "1", file="test/app/file{n}_test.exs", good_file="lib/app/file{n}_test.exs"),
    "testing.prefer_selector_assertions_for_html": Example(_f('    assert html =~ "<a id=\\"x\\" class=\\"y\\">"'), _f('    assert html =~ "<a id=\\"x\\"><b class=\\"y\\">"'), file=_TEST),
}


#: Where the issues of each faulty text are, as line:column.
PLACES: dict[str, str] = {
    "ecto.composable_preload_queries": "2:41",
    "ecto.context_owns_schema_queries": "3:21",
    "ecto.error_changeset_pattern_match": "4:7",
    "ecto.named_binding": "3:10 4:13",
    "ecto.no_and_in_where": "3:28 4:37",
    "ecto.no_data_changes_in_schema_migrations": "3:10 4:13",
    "ecto.no_repo_preload_after_query": "3:32 5:10",
    "ecto.no_repo_transaction": "3:10",
    "ecto.own_context_for_schema": "1:1",
    "ecto.pipe_based_queries": "3:5",
    "ecto.prefer_datetime_over_date": "3:5",
    "ecto.prefer_order_by_over_repo_all_enum_sort": "3:29 4:10",
    "ecto.prefer_repo_aggregate_count": "3:29 4:5 5:31",
    "ecto.prefer_repo_one_over_all_first": "3:29 4:5 5:29",
    "ecto.prefer_select_over_repo_all_enum_map": "3:29 4:10",
    "ecto.use_my_app_schema": "2:3",
    "elixir.app_module_acronym_casing": "2:9",
    "elixir.doc_before_spec": "3:3",
    "elixir.filter_reject_first": "3:38 4:10",
    "elixir.float_usage": "3:11 4:7",
    "elixir.fully_specified_struct_types": "2:14",
    "elixir.fully_typed_opts": "2:18 3:18",
    "elixir.named_spec_params": "2:3",
    "elixir.no_catch_all_in_with_else": "6:7",
    "elixir.no_end_of_day_time": "3:21",
    "elixir.no_extra_public_behaviour_functions": "4:3",
    "elixir.no_low_level_process_primitives": "3:13 4:15 5:10",
    "elixir.no_param_extraction_in_function_head": "2:11 3:8",
    "elixir.no_passthrough_wrapper": "2:3",
    "elixir.no_raise": "3:5 4:10 5:14",
    "elixir.no_remote_calls_in_module_attributes": "2:21",
    "elixir.no_result_tuple_argument": "2:3",
    "elixir.no_then": "3:10 4:5",
    "elixir.no_try_rescue": "3:5",
    "elixir.prefer_block_if": "3:5",
    "elixir.prefer_empty_list_checks": "3:7 4:8",
    "elixir.prefer_enum_count": "3:5 4:17",
    "elixir.prefer_enum_uniq_by": "3:36",
    "elixir.prefer_list_type_syntax": "2:3",
    "elixir.reject_count": "3:38",
    "elixir.simple_tagged_tuple_values": "3:5 4:5",
    "elixir.use_maybe_in_function_name": "2:3",
    "elixir.with_else_clause": "3:5",
    "heex.no_duplicate_static_ids": "4:22",
    "heex.no_element_spacing": "4:15 4:20",
    "heex.no_indirect_assign_access": "4:8 4:37",
    "heex.no_javascript_href": "4:8",
    "heex.prefer_link_for_navigation": "4:10",
    "heex.prefer_native_interactive_element": "4:5",
    "heex.require_accessible_button_text": "4:5",
    "heex.require_button_type": "4:5",
    "heex.require_image_alt": "4:5",
    "heex.require_label_for_input": "4:5 4:19",
    "heex.require_link_href": "4:5",
    "heex.require_link_text": "4:5",
    "heex.require_loading_state_for_submit": "4:26 4:65",
    "heex.require_target_blank_rel": "4:5",
    "heex.design_system.no_arbitrary_spacing": "4:8 4:37",
    "phoenix.context_function_naming": "2:3 3:3 4:3",
    "phoenix.no_repo_in_controller": "3:14",
    "phoenix.uri_decode_query": "3:9",
    "phoenix.use_verified_routes": "3:14 4:21",
    "phoenix_live_view.no_inline_assign_in_return_tuple": "3:39 4:35",
    "phoenix_live_view.require_explicit_connection_state_handling_in_mount": "3:3",
    "phoenix_live_view.require_function_component_attrs": "3:3",
    "testing.no_describe_blocks": "3:3",
    "testing.no_global_state_in_tests": "3:17 4:12",
    "testing.no_setup_in_tests": "2:3 5:3",
    "testing.no_tests_in_test_dir": "1:1",
    "testing.prefer_selector_assertions_for_html": "3:5",
}

#: Further texts of a check, with the places of their issues.
MORE: dict[str, list[tuple[str, str]]] = {
    "ecto.composable_preload_queries": [
        (_m("  def a_preload_query(q) do\n    preloads = [:file, author: :team]\n    q |> preload(^preloads)\n  end"), "4:10"),
        (_m("  def a_preload_query(q, preloads) do\n    q |> preload(^preloads)\n  end\n  def b_preload_query(q, x) do\n    preloads = [x]\n    preload(q, ^preloads)\n  end"), ""),
    ],
    "ecto.no_and_in_where": [(_m("  def run(x) do\n    from(p in Post, where: p.a == 1, where: p.b == 2)\n  end"), "")],
    "ecto.prefer_select_over_repo_all_enum_map": [
        (_f('    x |> Repo.all() |> Enum.map(&%{"role" => &1.role, "text" => &1.text})\n    x |> Repo.all() |> Enum.map(fn m -> %{"role" => m.role, "text" => m.text} end)'), "3:29 4:29"),
        (_f('    x |> Repo.all() |> Enum.map(&%{"role" => work(&1.role)})\n    x |> Repo.all() |> Enum.map(fn m -> %{} end)'), ""),
    ],
    "elixir.named_spec_params": [(_m("  @callback handle(Id.t(), integer()) :: :ok\n  @macrocallback build(term()) :: Macro.t()"), ""), (_m("  @spec a(x :: integer()) :: :ok\n  @spec b(term()) :: :ok\n  @spec c() :: :ok"), "3:3")],
    "elixir.no_passthrough_wrapper": [
        (_m("  def call(x), do: wrap(x)\n  defp wrap(x), do: x |> String.trim()\n  defp day(%DateTime{} = at), do: DateTime.to_iso8601(at)"), "3:3 4:3"),
        (_m("  defp wrap(x), do: x |> String.trim() |> String.upcase()\n  defp day(%DateTime{year: y} = at), do: show(at)\n  defp turn(a, b), do: b |> Other.call(a)"), ""),
    ],
    "elixir.no_remote_calls_in_module_attributes": [
        (_m("  @a __MODULE__.values()\n  @b __MODULE__.Nested.values()\n  @c &App.Config.limit/1"), "2:17 3:24 4:18"),
        (_m("  alias App.Enum\n  @a Enum.values()"), "3:11"),
        (_m("  alias Calendar.ISO, as: Days\n  @a Days.days_in_era(1)\n  @b Elixir.Enum.uniq([1])\n  @c :maps.from_list([])\n  @d App.Posts\n  @e fn x -> App.work(x) end"), ""),
        (_m("  @a :app_native.limits()\n  @b Map.new(a: App.Config.limit())"), "2:18 3:28"),
    ],
    "heex.no_duplicate_static_ids": [(_h('<.field id="a" /><.field id="a" /><Form id="b" /><Form id="b" />'), ""), (_h('<p id="a"></p>\n    <i id="a"></i><b id="a"></b>'), "5:8 5:22")],
    "heex.no_element_spacing": [(_h('<div class="mt-4"'), ""), (_h('<div class="mt-4">\n    <p class="gap-4 ml-auto">'), "4:17 5:21")],
    "heex.no_javascript_href": [(_h("<a HREF=\"javascript:go()\">x</a><a href={@x}>y</a><.link href=\"javascript:go()\">z</.link>"), "4:8")],
    "heex.prefer_native_interactive_element": [(_h('<div phx-click="save"'), "")],
    "heex.require_accessible_button_text": [(_h('<button type="button"'), ""), (_h("<button>\n    </button><button> {@x} </button>"), "4:5")],
    "heex.require_button_type": [(_h("<button"), ""), (_h("<button>x</button><!-- <button> "), "")],
    "heex.require_image_alt": [(_h('<img src="x"'), ""), (_h('<img src={@x'), "")],
    "heex.require_target_blank_rel": [(_h('<.link target="_blank" href="/">x</.link>'), ""), (_h('<a target="_BLANK" rel="noreferrer">x</a><form target="_blank"></form>'), "4:5 4:46")],
    "testing.no_describe_blocks": [
        (_m('  use ExUnit.Case\n  Elixir.ExUnit.Case.describe "x" do\n    test "y" do\n      assert true\n    end\n  end'), "3:22"),
        (_m('  use ExUnit.Case\n  alias Elixir.ExUnit.Case, as: Tests\n  Tests.describe "x" do\n    :ok\n  end\n  Other.describe "x" do\n    :ok\n  end'), "4:9"),
    ],
}


def variants(check: str) -> list[tuple[str, str, str]]:
    """File, text and places of the issues, for the supplier numbers modulo their count."""
    e = EXAMPLES[check]
    return [(e.file, e.bad, PLACES[check]), (e.good_file or e.file, e.good, ""), *[(e.file, text, at) for text, at in MORE.get(check, [])]]


def files(spark: SparkSession, sf_dir: str, check: str) -> DataFrame:
    """A file for each supplier."""
    name = lambda pattern: F.concat(F.lit(pattern.split("{n}")[0]), F.col("s_suppkey").cast("string"), F.lit(pattern.split("{n}")[1]))
    given = variants(check)
    at, path, content = F.col("s_suppkey") % len(given), name(given[-1][0]), F.lit(given[-1][1])
    for k, (file, text, _) in enumerate(given[:-1]):
        path, content = F.when(at == k, name(file)).otherwise(path), F.when(at == k, F.lit(text)).otherwise(content)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", path.alias("file"), content.alias("content"))


def _run(check: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = files(spark, sf_dir, check)
        place = lambda name: F.get_json_object("meta", f"$.{name}").cast("int").alias(name)
        issues = source.validate(given, [(check, EXAMPLES[check].options)]).select("subject", F.col("check").alias("check_name"), place("line"), place("column"))
        return given.join(issues, given["file"] == issues["subject"]).select("s_suppkey", "check_name", "line", F.col("column").alias("col"))

    return run


def name_of(check: str) -> str:
    return "source_" + check.replace(".", "_")


def _sql(check: str) -> str:
    """The places as a table, by the number that a supplier's text has."""
    given = variants(check)
    rows = ", ".join(f"({k}, {line}, {column})" for k, (_, _, places) in enumerate(given) for line, column in (at.split(":") for at in places.split()))
    return f"SELECT s_suppkey, '{check}' AS check_name, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col FROM supplier JOIN (VALUES {rows}) t(k, line, col) ON s_suppkey % {len(given)} = k"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name_of(c): _run(c) for c in EXAMPLES}
ORACLE_SQL = {name_of(c): _sql(c) for c in EXAMPLES}
