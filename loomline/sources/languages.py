"""The built-in languages, in alphabetical order: all 544 of the reference. Another catalog is read from a path.

Columns: name, file patterns, line comments, block comments, nested, shebangs, keywords.
"""

from __future__ import annotations

# Names, patterns, comment tokens, shebangs and keywords that decide results.
LANGUAGES = [
    ('8th', ['*.8th'], ['\\'], [('(*', '*)')], True, [], []),
    ('ABAP', ['*.abap'], ['*'], [], False, [], []),
    ('ABNF', ['*.abnf'], [';'], [], False, [], []),
    ('ActionScript', ['*.as'], ['//'], [('/*', '*/')], False, [], ['package', 'import', 'function', 'var', 'flash.display', 'Vector.<']),
    ('Ada', ['*.ada', '*.adb', '*.ads'], ['--'], [], False, [], ['procedure', 'function', 'package', 'with', 'use', 'begin', 'end', 'is', 'record']),
    ('AFL', ['*.afl'], ['//'], [('/*', '*/')], False, [], []),
    ('Agda', ['*.agda', '*.lagda'], ['--'], [('{-', '-}')], True, [], []),
    ('Aiken', ['*.ak'], ['//'], [('/*', '*/')], False, [], []),
    ('Alchemist', ['*.crn'], ['#'], [], False, [], []),
    ('Alex', ['*.x'], [], [], False, [], []),
    ('Algol 68', ['*.a68'], [], [('#', '#'), ('CO', 'CO'), ('COMMENT', 'COMMENT')], False, [], []),
    ('Alloy', ['*.als'], ['//', '--'], [('/*', '*/')], False, [], []),
    ('AMPL', ['*.ampl', '*.mod', '*.dat', '*.run'], ['#'], [('/*', '*/')], False, [], ['param', 'var', 'subject to', 'minimize', 'maximize', 'set']),
    ('Android Interface Definition Language', ['*.aidl'], ['//'], [('/**', '*/'), ('/*', '*/')], False, [], []),
    ('AngelScript', ['*.as', '*.angelscript'], ['//'], [('/*', '*/')], False, [], ['funcdef', 'shared', 'mixin', 'dictionary', 'array<', 'uint8', 'int64']),
    ('ANTLR', ['*.g4'], ['//'], [('/*', '*/')], False, [], []),
    ('Apache Config', ['.htaccess', '*.conf', 'httpd.conf', 'apache2.conf'], ['#'], [], False, [], []),
    ('Apex', ['*.apex', '*.apexcls', '*.trigger'], ['//'], [('/*', '*/')], False, [], []),
    ('APL', ['*.apl', '*.aplf', '*.apls'], ['⍝'], [], False, [], []),
    ('AppleScript', ['*.scpt', '*.applescript'], ['--', '#'], [('(*', '*)')], False, [], []),
    ('Arc', ['*.arc'], [';'], [], False, [], []),
    ('ArkTs', ['*.ets'], ['//'], [('/*', '*/')], False, [], []),
    ('Arturo', ['*.art'], [';'], [], False, [], []),
    ('AsciiDoc', ['*.adoc', '*.asciidoc', '*.asc'], ['//'], [('////', '////')], False, [], []),
    ('ASN.1', ['*.asn1'], ['--'], [('/*', '*/')], False, [], []),
    ('ASP', ['*.asp', '*.asa'], ["'", 'rem'], [], False, [], []),
    ('ASP.NET', ['*.asax', '*.ascx', '*.asmx', '*.aspx', '*.master', '*.sitemap', '*.webinfo'], [], [('<!--', '-->'), ('<%--', '--%>')], False, [], []),
    ('AspectJ', ['*.aj'], ['//'], [('/*', '*/')], False, [], []),
    ('Assembly', ['*.asm', '*.s', '*.S'], [';', '#', '//'], [('/*', '*/')], False, [], []),
    ('Astro', ['*.astro'], ['//'], [('/*', '*/'), ('<!--', '-->')], False, [], []),
    ('Ats', ['*.dats', '*.hats', '*.sats', '*.atxt'], ['//'], [('(*', '*)'), ('/*', '*/')], False, [], []),
    ('Austral', ['*.aum', '*.aui'], ['--'], [('(*', '*)')], False, [], []),
    ('AutoHotkey', ['*.ahk', '*.ahkl', '*.ah2'], [';'], [('/*', '*/')], False, [], []),
    ('AutoIt', ['*.au3'], [';'], [('#comments-start', '#comments-end'), ('#cs', '#ce')], False, [], []),
    ('Automake', ['*.am'], ['#'], [], False, [], []),
    ('Avro', ['*.avsc', '*.avdl', '*.avpr'], ['//'], [('/*', '*/')], False, [], []),
    ('AWK', ['*.awk', '*.gawk', '*.nawk'], ['#'], [], False, ['#!/bin/awk -f', '#!/usr/bin/awk -f', '#!/usr/bin/env awk', '#!/usr/bin/env gawk'], []),
    ('AXAML', ['*.axaml'], [], [('<!--', '-->')], False, [], []),
    ('B', ['*.b'], [], [('/*', '*/')], False, [], ['auto', 'break', 'case', 'default', 'do', 'else', 'extern', 'extrn', 'for', 'goto', 'if', 'main', 'read', 'return', 'static', 'switch', 'while', 'write']),
    ('Ballerina', ['*.bal'], ['//', '#'], [], False, [], []),
    ('Bash', ['*.bash', '*.sh', '.login', '.profile', '.bash_logout', '.bash_profile', '.bashrc', '.bash_aliases'], ['#'], [], False, ['#!/bin/bash', '#!/usr/bin/env bash', '#!/bin/sh', '#!/usr/bin/env sh'], []),
    ('Batch', ['*.bat', '*.cmd'], ['rem', '::'], [], False, [], []),
    ('Bazel', ['*.bzl', '*.bazel', '*.bzlmod', 'BUILD', 'BUILD.bazel', 'build', 'build.bazel', 'WORKSPACE', 'WORKSPACE.bazel', 'workspace', 'MODULE', 'MODULE.bazel', 'module'], ['#'], [], False, [], []),
    ('BCPL', ['*.bcpl'], [], [('/*', '*/')], False, [], []),
    ('BCX/FreeBASIC', ['*.bas', '*.bi'], ["'", 'rem'], [('$comment', '$comment')], False, [], []),
    ('Bean', ['*.bean', '*.beancount'], [';'], [], False, [], []),
    ('Beef', ['*.beef'], ['//'], [('/*', '*/')], False, [], []),
    ('Bend', ['*.bend'], ['//', '#'], [], False, [], []),
    ('BGT', ['*.bgt'], ['//'], [('/*', '*/')], False, [], []),
    ('BibTeX', ['*.bib', '*.bst'], ['%'], [], False, [], []),
    ('Bicep', ['*.bicep', '*.bicepparam'], ['//'], [('/*', '*/')], False, [], []),
    ('Bison', ['*.y', '*.yy'], ['//'], [('/*', '*/')], False, [], ['%token', '%type', '%start', 'yyparse']),
    ('BitBake', ['*.bb', '*.bbappend', '*.bbclass', '*.inc'], ['#'], [], False, [], ['DESCRIPTION', 'LICENSE', 'SRC_URI', 'do_compile', 'do_install', 'inherit', 'DEPENDS']),
    ('BlitzBasic', ['*.bb', '*.decls', '*.bb2'], [';'], [], False, [], ['Graphics', 'Graphics3D', 'Camera', 'Mesh', 'Type', 'Field', 'New', 'Repeat', 'Until', 'Forever']),
    ('Bluespec', ['*.bsv'], ['//'], [('/*', '*/')], False, [], []),
    ('Boo', ['*.boo'], ['#'], [], False, [], []),
    ('Bosque', ['*.bsq'], ['//'], [('/*', '*/')], False, [], []),
    ('BQN', ['*.bqn'], ['#'], [], False, [], []),
    ('Brainfuck', ['*.bf', '*.b'], [], [], False, [], ['>', '<', '+', '-', '.', ',', '[', ']']),
    ('BrightScript', ['*.brs'], ["'", 'rem'], [], False, [], []),
    ('Buck', ['BUCK'], ['#'], [], False, [], []),
    ('C', ['*.c', '*.h', '*.ec', '*.pgc'], ['//'], [('/*', '*/')], False, [], ['#include', '#define', 'int main', 'void', 'sizeof', 'typedef', 'struct']),
    ('C Shell', ['*.csh'], ['#'], [], False, ['#!/bin/csh'], []),
    ('C#', ['*.cs', '*.csx', '*.cake', '*.cshtml.cs', '*.razor.cs'], ['//'], [('/*', '*/')], False, [], []),
    ('C++', ['*.cpp', '*.hpp', '*.c++', '*.h++', '*.cc', '*.cxx', '*.hxx', '*.ino', '*.ipp', '*.cppm', '*.ixx', '*.c++m', '*.pcc', '*.tpp'], ['//'], [('/*', '*/')], False, [], []),
    ('C2', ['*.c2'], ['//'], [('/*', '*/')], False, [], []),
    ('C3', ['*.c3'], ['//'], [('/*', '*/'), ('<*', '*>')], True, [], []),
    ('Cabal', ['*.cabal', 'cabal.project', 'cabal.project.freeze'], ['--'], [('{-', '-}')], True, [], []),
    ('Caddyfile', ['Caddyfile', '*.caddyfile'], ['#'], [], False, [], []),
    ('Cadence', ['*.cdc'], ['//'], [('/*', '*/')], False, [], []),
    ('Cairo', ['*.cairo'], ['//'], [], False, [], []),
    ('Cangjie', ['*.cj'], ['//'], [('/*', '*/')], True, [], []),
    ("Cap'n Proto", ['*.capnp'], ['#'], [], False, [], []),
    ('Carbon', ['*.carbon'], ['//'], [('/*', '*/')], False, [], []),
    ('Carp', ['*.carp'], [';'], [], False, [], []),
    ('Cassius', ['*.cassius'], ['//'], [('/*', '*/')], False, [], []),
    ('Catala', ['*.catala_en', '*.catala_fr', '*.catala_pl'], ['#'], [], False, [], []),
    ('CEL', ['*.cel'], ['//'], [], False, [], []),
    ('Ceylon', ['*.ceylon'], ['//'], [('/*', '*/')], False, [], []),
    ('Cg', ['*.cg', '*.cgfx'], ['//'], [('/*', '*/')], False, [], []),
    ('ChaiScript', ['*.chai'], ['//'], [('/*', '*/')], False, [], []),
    ('Chapel', ['*.chpl'], ['//'], [('/*', '*/')], False, [], []),
    ('ChucK', ['*.ck'], ['//'], [('/*', '*/')], False, [], []),
    ('Cilk', ['*.cilk', '*.cilkh'], ['//'], [('/*', '*/')], False, [], []),
    ('Circom', ['*.circom'], ['//'], [('/*', '*/')], False, [], []),
    ('Clarity', ['*.clar'], [';;'], [], False, [], []),
    ('Clean', ['*.icl', '*.dcl'], ['//'], [('/*', '*/')], False, [], []),
    ('CLIPS', ['*.clp'], [';'], [], False, [], []),
    ('Clojure', ['*.clj', '*.cljs', '*.cljc', '*.edn'], [';'], [('(comment', ')')], False, ['#!/usr/bin/env clojure', '#!/usr/bin/clojure'], []),
    ('CMake', ['*.cmake', '*.cmake.in', '*.cmake.rule', 'CMakeLists.txt', 'cmakelists.txt'], ['#'], [], False, [], []),
    ('COBOL', ['*.cob', '*.cbl', '*.ccp', '*.cobol', '*.cpy'], ['*'], [], False, [], []),
    ('Cobra', ['*.cobra'], ['#'], [('/#', '#/')], False, [], []),
    ('Coconut', ['*.coco', '*.coconut'], ['#'], [('"""', '"""'), ("'''", "'''")], False, [], []),
    ('CodeQL', ['*.ql', '*.qll'], ['//'], [('/*', '*/')], False, [], []),
    ('CoffeeScript', ['*.coffee', '*.cjsx'], ['#'], [('###', '###')], False, [], []),
    ('Cogent', ['*.cogent'], ['--'], [], False, [], []),
    ('ColdFusion', ['*.cfm', '*.cfc'], ['//'], [('<!---', '--->'), ('/*', '*/')], False, [], []),
    ('Common Lisp', ['*.lisp', '*.lsp', '*.asd', '*.cl'], [';'], [('#|', '|#')], True, [], ['defun', 'defvar', 'defclass', 'let', 'lambda', 'setf']),
    ('Coq', ['*.coq', '*.v'], [], [('(*', '*)')], True, [], ['Theorem', 'Lemma', 'Proof', 'Qed', 'Inductive', 'Definition', 'Require']),
    ('Crystal', ['*.cr'], ['#'], [], False, ['#!/usr/bin/crystal'], []),
    ('CSON', ['*.cson'], ['#'], [('###', '###')], False, [], []),
    ('CSS', ['*.css', '*.postcss'], [], [('/*', '*/')], False, [], []),
    ('CSV', ['*.csv'], [], [], False, [], []),
    ('CUDA', ['*.cu', '*.cuh', '*.ptx'], ['//'], [('/*', '*/')], False, [], []),
    ('CUE', ['*.cue'], ['//'], [('/*', '*/')], False, [], []),
    ('Curl', ['*.curl'], ['||'], [('|#', '#|')], False, [], []),
    ('Curry', ['*.curry'], ['--'], [('{-', '-}')], True, [], []),
    ('Cyber', ['*.cy'], ['--'], [('--[[', ']]')], False, [], []),
    ('Cypher', ['*.cypher', '*.cyp', '*.cql'], ['//'], [('/*', '*/')], False, [], []),
    ('Cython', ['*.pyx', '*.pxd', '*.pxi'], ['#'], [], False, [], []),
    ('D', ['*.d', '*.di'], ['//'], [('/*', '*/'), ('/+', '+/')], True, ['#!/usr/bin/env rdmd', '#!/usr/bin/rdmd'], []),
    ('D2', ['*.d2'], ['#'], [('"""', '"""')], False, [], []),
    ('Dafny', ['*.dfy'], ['//'], [('/*', '*/')], False, [], []),
    ('DAML', ['*.daml'], ['--'], [('{-', '-}')], True, [], []),
    ('Dart', ['*.dart'], ['//', '///'], [('/*', '*/')], False, [], []),
    ('Datalog', ['*.dl', '*.datalog'], ['//', '%'], [('/*', '*/')], False, [], []),
    ('Delphi/Object Pascal', ['*.dpr', '*.dpk'], ['//'], [('(*', '*)'), ('{', '}')], True, [], []),
    ('Device Tree', ['*.dts', '*.dtsi'], ['//'], [('/*', '*/')], False, [], []),
    ('Dhall', ['*.dhall'], ['--'], [('{-', '-}')], True, [], []),
    ('Diff', ['*.diff', '*.patch'], ['#'], [], False, [], []),
    ('Djot', ['*.dj', '*.djot'], [], [('<!--', '-->')], False, [], []),
    ('Dockerfile', ['*.dockerfile', 'Dockerfile'], ['#'], [], False, [], []),
    ('Dotenv', ['.env', '.env.*'], ['#'], [], False, [], []),
    ('DotNet Resource', ['*.resx'], [], [('<!--', '-->')], False, [], []),
    ('Dream Maker', ['*.dm', '*.dme'], ['//'], [('/*', '*/')], True, [], []),
    ('Dust.js', ['*.dust'], [], [('{!', '!}')], False, [], []),
    ('Dylan', ['*.dylan', '*.lid'], ['//'], [('/*', '*/')], False, [], []),
    ('E', ['*.E'], ['#'], [('/*', '*/')], False, [], []),
    ('Earthfile', ['Earthfile', '*.earth', '*.earthfile'], ['#'], [], False, [], []),
    ('EasyLanguage', ['*.eld', '*.ela', '*.elw'], ['//'], [('{', '}')], False, [], []),
    ('EBNF', ['*.ebnf'], ['//'], [('(*', '*)')], False, [], []),
    ('Ebuild', ['*.ebuild', '*.eclass'], ['#'], [], False, [], []),
    ('EdgeQL', ['*.edgeql'], ['#'], [], False, [], []),
    ('EditorConfig', ['.editorconfig'], ['#', ';'], [], False, [], ['root', 'indent_style', 'indent_size', 'charset', 'end_of_line']),
    ('EEx', ['*.eex', '*.leex', '*.heex'], [], [('<!--', '-->')], False, [], []),
    ('Effekt', ['*.effekt'], ['//'], [('/*', '*/')], False, [], []),
    ('Eiffel', ['*.e'], ['--'], [], False, [], ['class', 'feature', 'is', 'do', 'end', 'require', 'ensure', 'invariant']),
    ('EJS', ['*.ejs'], ['//'], [('/*', '*/'), ('<!--', '-->')], False, [], []),
    ('Elixir', ['*.ex', '*.exs', 'mix.lock'], ['#'], [], False, ['#!/usr/bin/env elixir'], ['defmodule', 'def', 'defp', 'do', 'end', '|>']),
    ('Elm', ['*.elm'], ['--'], [('{-', '-}')], True, [], []),
    ('Elvish', ['*.elv'], ['#'], [], False, ['#!/usr/bin/env elvish'], []),
    ('Emacs Dev Env', ['*.ede'], [';'], [], False, [], []),
    ('Emacs Lisp', ['*.el'], [';'], [], False, [], []),
    ('EmberScript', ['*.em'], ['#'], [('###', '###')], False, [], []),
    ('Emojicode', ['*.emojic', '*.🍇'], ['💭'], [('💭🔜', '🔚💭'), ('📗', '📗'), ('📘', '📘')], False, [], []),
    ('ERB', ['*.erb', '*.html.erb', '*.erb.html'], [], [('<!--', '-->')], False, [], []),
    ('Erlang', ['*.erl', '*.hrl', '*.app.src', '*.yrl', '*.xrl'], ['%'], [], False, ['#!/usr/bin/env escript'], []),
    ('Euphoria', ['*.e', '*.ex', '*.exw', '*.ew', '*.eu'], ['--'], [('/*', '*/')], False, [], ['procedure', 'function', 'end procedure', 'end function', 'with', 'without']),
    ('Expect', ['*.exp'], ['#'], [], False, [], []),
    ('F#', ['*.fs', '*.fsi', '*.fsx', '*.fsscript'], ['//'], [('(*', '*)')], True, [], []),
    ('F*', ['*.fst', '*.fsti'], ['//'], [('(*', '*)')], True, [], []),
    ('Factor', ['*.factor'], ['!', '#!'], [('/*', '*/')], False, ['#!/usr/bin/env factor'], []),
    ('Fantom', ['*.fan'], ['//'], [('/*', '*/')], False, [], []),
    ('Faust', ['*.dsp'], ['//'], [('/*', '*/')], False, [], ['process =', 'process=', 'import(', 'declare ', 'library(', 'os.', 'ba.', 'si.']),
    ('Felix', ['*.flx'], ['//'], [('/*', '*/')], False, [], []),
    ('Fennel', ['*.fnl'], [';'], [], False, ['#!/usr/bin/env fennel'], []),
    ('Fish', ['*.fish'], ['#'], [], False, ['#!/bin/fish'], []),
    ('FlatBuffers Schema', ['*.fbs'], ['//'], [('/*', '*/')], False, [], []),
    ('Flix', ['*.flix'], ['//'], [('/*', '*/')], False, [], ['def', 'let', 'enum', 'match', 'namespace', 'use', 'pub', 'with', 'forall']),
    ('Forth', ['*.4th', '*.forth', '*.fr', '*.fth', '*.frt', '*.f83', '*.fb', '*.fpm', '*.e4', '*.rx', '*.ft'], ['\\ '], [('( ', ')')], False, [], [': ', '; ', 'DUP', 'DROP', 'SWAP', 'OVER', 'ROT', 'VARIABLE', 'CONSTANT', 'CREATE']),
    ('Fortran', ['*.f', '*.for', '*.f77', '*.f90', '*.f95', '*.f03', '*.f08', '*.f15', '*.f18', '*.f23'], ['!', 'C', 'c'], [], False, [], []),
    ('FreeMarker', ['*.ftl', '*.ftlh', '*.ftlx'], [], [('<#--', '-->')], False, [], []),
    ('Frege', ['*.fr'], ['--'], [('{-', '-}')], True, [], ['module', 'import', 'data', 'class', 'instance', 'native', 'pure']),
    ('Futhark', ['*.fut'], ['--'], [('{-', '-}')], True, [], []),
    ('GCode', ['*.gcode', '*.nc', '*.ngc', '*.cnc'], [';'], [], False, [], []),
    ('GDB Script', ['*.gdb'], ['#'], [], False, [], []),
    ('GDExtension', ['*.gdextension'], [';'], [], False, [], []),
    ('GDScript', ['*.gd'], ['#'], [], False, [], []),
    ('GDShader', ['*.gdshader'], ['//'], [('/*', '*/')], False, [], []),
    ('Genie', ['*.gs'], ['//'], [('/*', '*/')], False, [], ['init', 'uses', 'def', 'prop', 'construct']),
    ('Gettext', ['*.po', '*.pot'], ['#'], [], False, [], []),
    ('Gherkin', ['*.feature'], ['#'], [], False, [], []),
    ('Git Config', ['.gitconfig', '.gitmodules', '.gitattributes'], ['#', ';'], [], False, [], ['core', 'user', 'name', 'email', 'remote', 'url']),
    ('Gleam', ['*.gleam'], ['//', '///', '////'], [], False, [], []),
    ('GLSL', ['*.glsl', '*.vert', '*.frag', '*.geom', '*.tesc', '*.tese', '*.comp', '*.rcall', '*.rmiss', '*.rchit'], ['//'], [('/*', '*/')], False, [], []),
    ('GML', ['*.gml'], ['//'], [('/*', '*/')], False, [], []),
    ('GN Build', ['*.gn', '*.gni'], ['#'], [], False, [], []),
    ('Go', ['*.go', '*.tmpl', '*.gohtml', '*.gotmpl', 'go.mod', 'go.work'], ['//'], [('/*', '*/')], False, [], []),
    ('Gosu', ['*.gs', '*.gsx'], ['//'], [('/*', '*/')], False, [], ['package', 'uses', 'class', 'function', 'property', 'enhancement', 'var', 'final']),
    ('Grace', ['*.grace'], ['//'], [('/*', '*/')], False, [], []),
    ('Gradle', ['*.gradle', 'gradle.properties'], ['//'], [('/*', '*/')], False, [], []),
    ('Grain', ['*.gr'], ['//'], [('/*', '*/')], True, [], []),
    ('GraphQL', ['*.graphql', '*.gql', '*.graphqls'], ['#'], [], False, [], []),
    ('Graphviz/DOT', ['*.dot', '*.gv'], ['//'], [('/*', '*/')], False, [], []),
    ('Gremlin', ['*.gremlin'], ['//'], [('/*', '*/')], False, [], []),
    ('Groovy', ['*.groovy', '*.grt', '*.gtpl', '*.gvy', '*.gy', '*.gsh'], ['//'], [('/*', '*/')], False, ['#!/usr/bin/env groovy', '#!/usr/bin/groovy'], []),
    ('Gwion', ['*.gw'], ['#!'], [], False, [], []),
    ('Hack', ['*.hh', '*.hhi', '*.hack'], ['//', '#'], [('/*', '*/')], False, [], []),
    ('Haml', ['*.haml'], ['-#'], [], False, [], []),
    ('Hamlet', ['*.hamlet'], [], [('<!--', '-->')], False, [], []),
    ('Handlebars', ['*.hbs', '*.handlebars'], [], [('{{!--', '--}}')], False, [], []),
    ('Happy', ['*.y'], ['--'], [('{-', '-}')], False, [], ['%name', '%tokentype', '%token', '%%']),
    ('Harbour', ['*.prg', '*.hb', '*.ch'], ['//', '&&'], [('/*', '*/')], False, [], ['FUNCTION', 'PROCEDURE', 'CLASS', 'ENDCLASS', 'METHOD', 'DATA']),
    ('Hare', ['*.ha'], ['//'], [('/*', '*/')], False, [], []),
    ('Haskell', ['*.hs', '*.lhs', '*.hsc', '*.hs-boot', '.ghci'], ['--'], [('{-', '-}')], True, ['#!/usr/bin/env runhaskell'], []),
    ('Haxe', ['*.hx'], ['//'], [('/*', '*/')], False, [], []),
    ('HCL', ['*.hcl', '.terraform.lock.hcl'], ['#', '//'], [('/*', '*/')], False, [], ['job', 'group', 'task', 'source', 'build', 'provisioner', 'template']),
    ('Hjson', ['*.hjson'], ['//', '#'], [('/*', '*/')], False, [], []),
    ('HLSL', ['*.hlsl', '*.fx', '*.fxh', '*.hlsli'], ['//'], [('/*', '*/')], False, [], []),
    ('HolyC', ['*.hc', '*.zc'], ['//'], [('/*', '*/')], False, [], []),
    ('Hoon', ['*.hoon'], ['::'], [], False, [], []),
    ('HTML', ['*.html', '*.htm', '*.xht', '*.xhtml'], [], [('<!--', '-->')], False, [], []),
    ('Hurl', ['*.hurl'], ['#'], [], False, [], []),
    ('Hy', ['*.hy'], [';'], [], False, [], []),
    ('Hylo', ['*.hylo'], ['//'], [('/*', '*/')], False, [], []),
    ('Icon', ['*.icn'], ['#'], [], False, [], ['procedure', 'end', 'every', 'suspend', 'fail', 'return', 'local', 'static', 'global']),
    ('IDL', ['*.idl', '*.widl'], ['//'], [('/*', '*/')], False, [], []),
    ('Idris', ['*.idr', '*.lidr'], ['--'], [('{-', '-}')], True, [], []),
    ('Ignore', ['.gitignore', '.dockerignore', '.npmignore', '.eslintignore', '.prettierignore', '*.ignore', '*.dockerignore'], ['#'], [], False, [], []),
    ('Imba', ['*.imba'], ['#'], [], False, [], []),
    ('Inform 6', ['*.inf'], ['!'], [], False, [], ['Object', 'Class', 'Nearby', 'Verb', 'Include', 'Release']),
    ('Inform 7', ['*.ni', '*.i7x'], [], [('[', ']')], False, [], []),
    ('INI', ['*.ini', '*.cfg', '*.prefs', '.editorconfig', '.gitconfig', 'buildozer.spec'], [';', '#'], [], False, [], ['[', ']', '=']),
    ('Ink', ['*.ink'], ['//'], [('/*', '*/')], False, [], []),
    ('Inko', ['*.inko'], ['#'], [], False, [], []),
    ('Inno Setup', ['*.iss', '*.ish'], [';', '//'], [('{', '}'), ('(*', '*)')], True, [], []),
    ('INTERCAL', ['*.i', '*.intercal'], [], [], False, [], ['PLEASE', 'DO', 'COME FROM', 'ABSTAIN', 'REINSTATE']),
    ('Io', ['*.io'], ['//', '#'], [('/*', '*/')], False, [], []),
    ('Ioke', ['*.ik'], [';'], [], False, [], []),
    ('Isabelle', ['*.thy'], ['--'], [('{*', '*}'), ('(*', '*)'), ('‹', '›'), ('\\\\<open>', '\\\\<close>')], False, [], []),
    ('J', ['*.ijs'], ['NB.'], [], False, [], []),
    ('Jai', ['*.jai'], ['//'], [('/*', '*/')], True, [], []),
    ('Jakt', ['*.jakt'], ['//'], [('/*', '*/')], False, [], []),
    ('Janet', ['*.janet'], ['#'], [], False, ['#!/usr/bin/env janet'], []),
    ('Java', ['*.java', '*.jav'], ['//'], [('/**', '*/'), ('/*', '*/')], False, [], []),
    ('Java Properties', ['*.properties'], ['#', '!'], [], False, [], []),
    ('Java Server Pages', ['*.jsp'], ['//'], [('/*', '*/'), ('<!--', '-->')], False, [], []),
    ('JavaScript', ['*.js', '*.cjs', '*.jsx', '*.jscad', '*.jsfl', '*.mjs', '*.njs', '*.sjs', '*.ssjs', '*.xsjs', '*.xsjslib', '*.es', '*.es6', '*.jake', '.babelrc', '.eslintrc', '.prettierrc'], ['//'], [('/*', '*/')], False, ['#!/usr/bin/node', '#!/usr/bin/env node'], []),
    ('JAWS Script', ['*.jss', '*.jsh'], ['//'], [('/*', '*/')], False, [], []),
    ('Jinja2', ['*.j2', '*.jinja', '*.jinja2'], [], [('{#', '#}')], False, [], []),
    ('Jolie', ['*.ol', '*.iol'], ['//'], [('/*', '*/')], False, [], []),
    ('Joy', ['*.joy'], ['#'], [('(*', '*)')], False, [], []),
    ('jq', ['*.jq'], ['#'], [], False, [], []),
    ('JSLT', ['*.jslt'], ['//'], [], False, [], []),
    ('JSON', ['*.json', '*.geojson', '*.ndjson', '*.jsonl', 'package-lock.json', 'composer.lock', 'flake.lock', 'deno.lock'], [], [], False, [], []),
    ('JSON5', ['*.json5'], ['//'], [('/*', '*/')], False, [], []),
    ('JSONC', ['*.jsonc'], ['//'], [('/*', '*/')], False, [], []),
    ('Jsonnet', ['*.jsonnet', '*.libsonnet'], ['//', '#'], [('/*', '*/')], False, [], []),
    ('Jule', ['*.jule'], ['//'], [('/*', '*/')], False, [], []),
    ('Julia', ['*.jl'], ['#'], [('#=', '=#')], True, ['#!/usr/bin/env julia', '#!/usr/local/bin/julia'], []),
    ('Jupyter Notebook', ['*.ipynb'], [], [], False, [], []),
    ('Just', ['justfile', 'Justfile'], ['#'], [], False, ['#!/usr/bin/env just --justfile'], []),
    ('K', ['*.k'], ['/ '], [], False, [], []),
    ('Kaitai Struct', ['*.ksy'], ['#'], [], False, [], []),
    ('Kakoune script', ['*.kak'], ['#'], [], False, [], []),
    ('KCL', ['*.kcl'], ['#'], [], False, [], []),
    ('Kconfig', ['Kconfig', 'Kconfig.*', '*.kconfig'], ['#'], [], False, [], []),
    ('KDL', ['*.kdl'], ['//'], [('/*', '*/')], False, [], []),
    ('Kitten', ['*.ktn'], ['//'], [('/*', '*/')], False, [], []),
    ('Koka', ['*.kk'], ['//'], [('/*', '*/')], False, [], []),
    ('Korn Shell', ['*.ksh'], ['#'], [], False, ['#!/bin/ksh'], []),
    ('Kotlin', ['*.gradle.kts', '*.kt', '*.ktm', '*.kts'], ['//'], [('/*', '*/')], True, [], []),
    ('Kusto', ['*.kql', '*.csl'], ['//'], [('/*', '*/')], False, [], []),
    ('KV Language', ['*.kv'], ['#'], [], False, [], []),
    ('LALRPOP', ['*.lalrpop'], ['//'], [], False, [], []),
    ('Lasso', ['*.lasso', '*.las', '*.lasso9'], ['//'], [('/*', '*/')], False, [], []),
    ('Lauterbach CMM', ['*.cmm'], [';'], [], False, [], []),
    ('LD Script', ['*.ld', '*.lds'], [], [('/*', '*/')], False, [], []),
    ('Lean', ['*.lean', '*.hlean'], ['--'], [('/-', '-/')], False, [], []),
    ('Less', ['*.less'], ['//'], [('/*', '*/')], False, [], []),
    ('Lex', ['*.l', '*.lex'], ['//'], [('/*', '*/')], False, [], ['%%', 'yy', 'BEGIN', 'ECHO']),
    ('LFE', ['*.lfe'], [';'], [], False, ['#!/usr/bin/env lfe'], []),
    ('LIGO', ['*.ligo', '*.mligo', '*.jsligo', '*.religo'], ['//'], [('/*', '*/'), ('(*', '*)')], False, [], []),
    ('LilyPond', ['*.ly', '*.ily'], ['%'], [('%{', '%}')], False, [], []),
    ('Limbo', ['*.m'], ['#'], [], False, [], ['implement', 'include', 'con', 'fn', 'adt', 'Sys->print']),
    ('Lingua Franca', ['*.lf'], ['//', '#'], [('/*', '*/')], True, [], []),
    ('Liquid Templates', ['*.liquid'], [], [('<!--', '-->'), ('{% comment %}', '{% endcomment %}')], False, [], []),
    ('LiveScript', ['*.ls'], ['#'], [('/*', '*/')], False, [], []),
    ('LLVM IR', ['*.ll', '*.bc'], [';'], [], False, [], []),
    ('LLVM TableGen', ['*.td'], ['//'], [('/*', '*/')], False, [], []),
    ('Lobster', ['*.lobster'], ['//'], [('/*', '*/')], False, [], []),
    ('Logo', ['*.logo', '*.lg'], [';'], [], False, [], []),
    ('Logtalk', ['*.lgt', '*.logtalk'], ['%'], [('/*', '*/')], False, [], []),
    ('Lolcode', ['*.lol'], ['BTW'], [('OBTW', 'TLDR')], False, [], []),
    ('LPC', ['*.c'], ['//'], [('/*', '*/')], False, [], ['inherit', 'nomask', 'varargs', 'efun', 'mixed', 'mapping', 'create', 'init']),
    ('LSL', ['*.lsl'], ['//'], [('/*', '*/')], False, [], []),
    ('Lua', ['*.lua', '*.wlua', '*.rockspec', '.luacheckrc'], ['--'], [('--[[', ']]')], False, ['#!/usr/bin/lua', '#!/usr/bin/env lua'], []),
    ('Luau', ['*.luau', 'default.project.json', 'test.project.json', '.robloxrc'], ['--'], [('--[[', ']]')], False, ['#!/usr/bin/env luau'], []),
    ('Lucid', ['*.luc'], ['%%'], [], False, [], []),
    ('M4', ['*.m4'], ['#', 'dnl'], [], False, [], []),
    ('Madlang', ['*.mad'], ['#'], [('{#', '#}')], False, [], []),
    ('Makefile', ['*.mak', '*.make', '*.mk', '*.mkfile', 'BSDmakefile', 'GNUmakefile', 'Kbuild', 'Makefile', 'Makefile.boot', 'Makefile.frag', 'Makefile.in', 'Makefile.inc', 'Makefile.wat', 'makefile', 'makefile.sco', 'mkfile'], ['#'], [], False, [], []),
    ('Malbolge', ['*.mal', '*.malbolge'], [], [], False, [], []),
    ('MAML', ['*.maml'], ['#'], [], False, [], []),
    ('Maple', ['*.mpl', '*.mm'], ['#'], [('(*', '*)')], False, [], ['proc', 'end proc', 'module', 'end module', 'local', 'global']),
    ('Markdown', ['*.md', '*.markdown', '*.mdx', '*.mdown', '*.mdwn', '*.mkd', '*.mkdn', '*.mkdown', '*.ronn'], [], [('<!--', '-->')], False, [], []),
    ('Marko', ['*.marko'], ['//'], [('<!--', '-->')], False, [], []),
    ('Mathematica/Wolfram', ['*.wl', '*.wls'], [], [('(*', '*)')], False, [], []),
    ('MATLAB', ['*.m'], ['%'], [('%{', '%}')], False, [], ['function', 'classdef', 'end', 'disp', 'plot', 'elseif']),
    ('Maven', ['pom.xml'], [], [('<!--', '-->')], False, [], []),
    ('max', ['*.maxpat'], [], [], False, [], []),
    ('Maxima', ['*.mac', '*.wxm', '*.dem'], [], [('/*', '*/')], False, [], []),
    ('Menhir', ['*.menhir'], ['//'], [('(*', '*)'), ('/*', '*/')], True, [], ['%%', '%token', '%start', '%left', '%right', '%nonassoc']),
    ('Mercury', ['*.m'], ['%'], [('/*', '*/')], False, [], [':- module', ':- pred', ':- func', ':- type', 'io.write_string']),
    ('Meson', ['meson.build', 'meson_options.txt'], ['#'], [], False, [], []),
    ('MessagePack', ['*.msgpack'], [], [], False, [], []),
    ('Metal Shading Language', ['*.metal'], ['//'], [('/*', '*/')], False, [], []),
    ('Michelson', ['*.tz'], ['#'], [('(*', '*)')], False, [], []),
    ('Microsoft Developer Studio', ['*.dsp'], ['#'], [], False, [], ['# Microsoft Developer Studio', 'TARGTYPE', 'CFG=', '!IF', 'PROP', 'Package Owner']),
    ('Mint', ['*.mint'], [], [], False, [], []),
    ('Miranda', ['*.m'], ['||'], [], False, [], ['abstype', 'with', 'where', 'div', 'mod', 'otherwise', 'type', 'show']),
    ('Mlatu', ['*.mlt'], ['//'], [], False, [], []),
    ('Modelica', ['*.mo', '*.mos'], ['//'], [('/*', '*/')], False, [], []),
    ('Modula-2/3', ['*.m3', '*.mi'], [], [('(*', '*)')], True, [], []),
    ('Module Definition', ['*.def'], [';'], [], False, [], []),
    ('Mojo', ['*.mojo', '*.🔥'], ['#'], [('"""', '"""'), ("'''", "'''")], False, [], []),
    ('Monkey C', ['*.mc'], ['//'], [('/*', '*/')], False, [], []),
    ('Moo', ['*.moo'], ['//'], [('/*', '*/')], False, [], []),
    ('MoonBit', ['*.mbt', '*.mbti'], ['//'], [], False, [], []),
    ('MoonScript', ['*.moon'], ['--'], [], False, [], []),
    ('Motoko', ['*.mot'], ['//'], [('/*', '*/')], False, [], []),
    ('Move', ['*.move'], ['//'], [('/*', '*/')], False, [], []),
    ('MQL4', ['*.mq4', '*.mqh'], ['//'], [('/*', '*/')], False, [], ['#property', 'OrderSend', 'iMA', 'AccountBalance']),
    ('MQL5', ['*.mq5'], ['//'], [('/*', '*/')], False, [], ['#property', 'CTrade', 'CPositionInfo', 'input']),
    ('MSBuild', ['*.csproj', '*.vbproj', '*.fsproj', '*.props', '*.targets'], [], [('<!--', '-->')], False, [], []),
    ('MUMPS', ['*.m', '*.mps'], [';'], [], False, [], ['SET', 'KILL', 'QUIT', 'FOR', 'GOTO', 'HALT', 'WRITE', 'READ', '^']),
    ('Mun', ['*.mun'], ['//'], [('/*', '*/')], False, [], []),
    ('Mustache', ['*.mustache'], [], [('{{!', '}}')], False, [], []),
    ('MyST', ['*.myst'], [], [('<!--', '-->')], False, [], []),
    ('NASM', ['*.nasm'], [';', '#'], [('/*', '*/')], False, [], []),
    ('Nearley', ['*.ne'], ['#'], [], False, [], []),
    ('Nemerle', ['*.n'], ['//'], [('/*', '*/')], True, [], []),
    ('NEON', ['*.neon'], ['#'], [], False, [], []),
    ('Newspeak', ['*.ns', '*.ns2'], [], [('(*', '*)')], False, [], []),
    ('Nextflow', ['*.nextflow', '*.nf'], ['//'], [('/*', '*/')], False, [], []),
    ('Nginx Config', ['nginx.conf', '*.nginx'], ['#'], [], False, [], []),
    ('Nickel', ['*.ncl', '*.nickel'], ['#', '//'], [('/*', '*/')], False, [], []),
    ('Nim', ['*.nim', '*.nims', '*.nimble', '*.nimrod'], ['#', '##'], [('#[', ']#')], True, [], []),
    ('Ninja', ['build.ninja'], ['#'], [], False, [], []),
    ('Nix', ['*.nix'], ['#'], [('/*', '*/')], False, [], []),
    ('Noir', ['*.nr'], ['//'], [('/*', '*/')], False, [], ['fn', 'struct', 'impl', 'trait', 'use', 'mod', 'let', 'pub', 'contract', 'unconstrained']),
    ('Not Quite Perl', ['*.nqp'], ['#'], [('=begin', '=end')], False, [], []),
    ('NSIS', ['*.nsi', '*.nsh'], [';', '#'], [('/*', '*/')], False, [], []),
    ('NuGet Config', ['nuget.config', 'packages.config', 'nugetdefaults.config'], [], [('<!--', '-->')], False, [], []),
    ('Nunjucks Templates', ['*.njk'], [], [('{#', '#}')], False, [], []),
    ('Nushell', ['*.nu'], ['#'], [], False, ['#!/usr/bin/env nu'], ['def', 'let', 'mut', 'if', 'else', 'for', 'each', 'where', 'select', 'open', 'save']),
    ('nuspec', ['*.nuspec'], [], [('<!--', '-->')], False, [], []),
    ('NVGT', ['*.nvgt', '.nvgtrc'], ['//'], [('/*', '*/')], False, [], []),
    ('Oberon', ['*.ob', '*.ob2', '*.obx', '*.oberon'], [], [('(*', '*)')], True, [], []),
    ('Objective-C', ['*.m'], ['//'], [('/*', '*/')], False, [], ['@interface', '@implementation', '@protocol', '@property', '@synthesize', '@end', 'NSString', '#import', 'NSObject']),
    ('Objective-C++', ['*.mm'], ['//'], [('/*', '*/')], False, [], ['@interface', '@implementation', '@protocol', '@property', '@synthesize', '@end', '#import', 'NSString', 'class', 'template']),
    ('Objective-J', ['*.j', '*.sj'], ['//'], [('/*', '*/')], False, [], []),
    ('OCaml', ['*.ml', '*.mli', '*.mll', '*.mly'], [], [('(*', '*)')], True, [], []),
    ('Occam', ['*.occ'], ['--'], [], False, [], []),
    ('Octave', ['*.m'], ['#', '%'], [('#{', '#}'), ('%{', '%}')], False, [], ['function', 'endfunction', 'pkg', 'pkg load']),
    ('Odin', ['*.odin'], ['//'], [('/*', '*/')], True, [], []),
    ('ooc', ['*.ooc'], ['//'], [('/*', '*/')], False, [], []),
    ('Opa', ['*.opa'], ['//'], [('/*', '*/')], False, [], []),
    ('OpenCL', ['*.ocl', '*.cl'], [], [('/*', '*/')], False, [], ['__kernel', '__global', '__local', '__constant', 'get_global_id', 'get_local_id', 'barrier']),
    ('OpenEdge ABL', ['*.p', '*.w', '*.cls', '*.i'], [], [('/*', '*/')], False, [], ['DEFINE', 'VARIABLE', 'PROCEDURE', 'FUNCTION', 'END PROCEDURE', 'RUN', 'FOR EACH', 'DO:']),
    ('OpenQASM', ['*.qasm'], ['//'], [('/*', '*/')], False, [], []),
    ('OpenSCAD', ['*.scad'], ['//'], [('/*', '*/')], False, [], []),
    ('OpenType Feature File', ['*.fea'], ['#'], [], False, [], []),
    ('Org', ['*.org'], ['#'], [], False, [], []),
    ('Oxygene', ['*.oxygene'], ['//'], [('(*', '*)'), ('{', '}')], True, [], []),
    ('Oz', ['*.oz'], ['%'], [('/*', '*/')], False, [], []),
    ('P4', ['*.p4', '*.p4i'], ['//'], [('/*', '*/')], False, [], []),
    ('Pan', ['*.pan'], ['#'], [], False, [], []),
    ('ParaSail', ['*.psl', '*.psi'], ['//'], [('/*', '*/')], False, [], []),
    ('Pascal', ['*.pas', '*.pp', '*.p', '*.inc'], ['//'], [('(*', '*)'), ('{', '}')], True, [], ['program', 'begin', 'end', 'var', 'procedure', 'function', 'uses']),
    ('PeopleCode', ['*.ppl', '*.peoplecode'], ['REM'], [('/*', '*/')], False, [], []),
    ('Perl', ['*.pl', '*.al', '*.perl', '*.plx', '*.pm', 'rexfile', 'ack', 'cpanfile', 'cpanfile.snapshot'], ['#'], [('=pod', '=cut')], False, ['#!/usr/bin/perl', '#!/usr/bin/env perl'], []),
    ('Pest', ['*.pest'], ['//'], [], False, [], []),
    ('PHP', ['*.php', '*.php3', '*.php4', '*.php5', '*.phps', '*.phpt', '*.phtml'], ['//', '#'], [('/*', '*/'), ('<!--', '-->')], False, ['#!/usr/bin/php', '#!/usr/bin/env php'], []),
    ('Pico', ['*.pico'], ['\\\\'], [], False, [], []),
    ('PicoLisp', ['*.l'], ['#'], [], False, [], ['de', 'def', 'dm', 'class', 'rel', 'var']),
    ('Piet', ['*.piet'], [], [], False, [], []),
    ('Pike', ['*.pike', '*.pmod'], ['//'], [('/*', '*/')], True, [], []),
    ('Pine Script', ['*.pine'], ['//'], [('/*', '*/')], False, [], []),
    ('PKGBUILD', ['PKGBUILD'], ['#'], [], False, ['#!/bin/bash', '#!/usr/bin/env bash', '#!/bin/sh', '#!/usr/bin/env sh'], []),
    ('Pkl', ['*.pkl'], ['//'], [('/*', '*/')], False, [], []),
    ('PL/I', ['*.pl1', '*.pli'], [], [('/*', '*/')], False, [], []),
    ('PL/SQL', ['*.pls', '*.plb', '*.pck', '*.pkb', '*.pks', '*.plsql'], ['--'], [('/*', '*/')], False, [], []),
    ('PlantUML', ['*.puml'], ["'"], [("/'", "'/")], False, [], []),
    ('PogoScript', ['*.pogo'], ['//'], [('/*', '*/')], False, [], []),
    ('Poke', ['*.pk'], [], [('/*', '*/')], False, [], []),
    ('Polar', ['*.polar'], ['#'], [], False, [], []),
    ('Pony', ['*.pony'], ['//'], [('/*', '*/')], False, [], []),
    ('PostCSS', ['*.pcss', '*.sss'], ['//'], [('/*', '*/')], False, [], []),
    ('PostScript', ['*.ps', '*.eps'], ['%'], [], False, [], []),
    ('PowerBuilder', ['*.pbl', '*.pbt', '*.pbw', '*.srd', '*.sru', '*.srw'], ['//'], [('/*', '*/')], False, [], []),
    ('PowerShell', ['*.ps1', '*.psm1', '*.psd1', '*.ps1xml', '*.cdxml', '*.pssc', '*.psc1'], ['#'], [('<#', '#>')], False, [], []),
    ('Prisma', ['*.prisma'], ['//'], [('/*', '*/')], False, [], []),
    ('Processing', ['*.pde'], ['//'], [('/*', '*/')], False, [], []),
    ('Prolog', ['*.pro', '*.P', '*.prolog', '*.yap'], ['%'], [('/*', '*/')], False, [], [':-', '?-', 'assert', 'retract', 'findall', 'bagof']),
    ('Promela', ['*.pml'], ['//'], [('/*', '*/')], False, [], []),
    ('PromQL', ['*.promql'], ['#'], [], False, [], []),
    ('Protocol Buffers', ['*.proto'], ['//'], [('/*', '*/')], False, [], []),
    ('PRQL', ['*.prql'], ['#'], [], False, [], []),
    ('Pug', ['*.pug', '*.jade'], ['//', '//-'], [], False, [], []),
    ('Puppet', ['*.pp'], ['#'], [('/*', '*/')], False, [], ['class', 'define', 'node', 'package', 'service', 'file', 'exec', '=>']),
    ('PureBasic', ['*.pb', '*.pbi', '*.pbf', '*.pbp'], [';'], [], False, [], []),
    ('PureScript', ['*.purs'], ['--'], [('{-', '-}')], True, [], []),
    ('Pyret', ['*.arr'], ['#'], [('#|', '|#')], False, [], []),
    ('Python', ['*.py', '*.pyi', '*.pyw', '*.py2', '*.py3', '*.pip', '*.pyz', '*.pyzw', '.gclient', 'SConscript', 'SConstruct', 'Snakefile', 'requirements.txt', 'Pipfile', '.pythonrc', 'py.typed'], ['#'], [('"""', '"""'), ("'''", "'''")], False, ['#!/usr/bin/python', '#!/usr/bin/env python', '#!/usr/bin/python3', '#!/usr/bin/env python3'], []),
    ('Q', ['*.q'], ['/'], [], False, [], []),
    ('Q#', ['*.qs'], ['//'], [('/*', '*/')], False, [], []),
    ('QBE IR', ['*.qbe'], ['#'], [], False, [], []),
    ('QCL', ['*.qcl'], ['//'], [('/*', '*/')], False, [], []),
    ('QMake', ['*.pro', '*.pri'], ['#'], [], False, [], ['TEMPLATE', 'CONFIG', 'QT', 'TARGET', 'SOURCES', 'HEADERS', 'INCLUDEPATH']),
    ('QML', ['*.qml'], ['//'], [('/*', '*/')], False, [], []),
    ('Quint', ['*.qnt'], ['//'], [('/*', '*/')], False, [], []),
    ('Quorum', ['*.quorum'], ['//'], [('/*', '*/')], False, [], []),
    ('R', ['*.r', '*.R', '*.rmd', '*.Rmd', '.Rprofile'], ['#'], [], False, [], ['<-', 'function', 'library', 'data.frame', 'ggplot', 'lm']),
    ('Racket', ['*.rkt', '*.rktd', '*.rktl', '*.rktm'], [';'], [('#|', '|#')], True, ['#!/usr/bin/env racket'], []),
    ('Raku', ['*.raku', '*.rakumod', '*.rakutest', '*.pm6', '*.pl6', '*.p6'], ['#', '#|'], [('#`(', ')'), ('=begin', '=end')], False, ['#!/usr/bin/raku', '#!/usr/bin/perl6'], []),
    ('RAML', ['*.raml', '*.rml'], ['#'], [], False, [], []),
    ('Rascal', ['*.rsc'], ['//'], [('/*', '*/')], False, [], []),
    ('Razor', ['*.cshtml', '*.razor'], [], [('<!--', '-->'), ('@*', '*@')], False, [], ['@page', '@model', '@inject', '@code', '@functions']),
    ('ReasonML', ['*.re', '*.rei'], ['//'], [('/*', '*/')], False, [], []),
    ('Rebol', ['*.r', '*.reb', '*.rebol'], [';'], [], False, [], ['REBOL', 'context', 'object!', 'func']),
    ('Red', ['*.red', '*.reds'], [';'], [('comment {', '}')], False, [], []),
    ('Rego', ['*.rego'], ['#'], [('/*', '*/')], False, [], ['package', 'import', 'default', 'allow', 'deny', 'rule', 'data', 'else', 'some']),
    ('ReScript', ['*.res', '*.resi'], ['//'], [('/*', '*/')], False, [], []),
    ('reStructuredText', ['*.rst'], ['..'], [], False, [], []),
    ('REXX', ['*.rexx', '*.rex'], [], [('/*', '*/')], False, [], []),
    ('Rhai', ['*.rhai'], ['//'], [('/*', '*/')], False, [], []),
    ('Ring', ['*.ring', '*.rh'], ['#', '//'], [('/*', '*/')], False, [], []),
    ('Robot Framework', ['*.robot'], ['#'], [], False, [], []),
    ('Roc', ['*.roc'], ['#'], [], False, [], []),
    ('Rockstar', ['*.rock', '*.rockstar', '*.rock.star'], [], [], False, [], []),
    ('Roff', ['*.roff', '*.troff', '*.man', '*.1', '*.2', '*.3', '*.4', '*.5', '*.6', '*.7', '*.8'], ['.\\"', '\\"'], [], False, [], ['.TH', '.SH', '.TP', '.PP', '.SS']),
    ('RON', ['*.ron'], ['//'], [('/*', '*/')], False, [], []),
    ('RPG', ['*.rpg', '*.rpgle', '*.sqlrpgle', '*.rpgmod'], ['//'], [], False, [], ['dcl-s', 'dcl-ds', 'dcl-pr', 'dcl-proc', 'end-proc']),
    ('Ruby', ['*.rb', '*.builder', '*.eye', '*.gemspec', '*.god', '*.jbuilder', '*.mspec', '*.pluginspec', '*.podspec', '*.rabl', '*.rake', '*.rbuild', '*.rbw', '*.rbx', '*.ruby', '*.thor', '*.watchr', '.irbrc', '.pryrc', 'Appraisals', 'Berksfile', 'Brewfile', 'Buildfile', 'Capfile', 'Dangerfile', 'Deliverfile', 'Fastfile', 'Gemfile', 'Guardfile', 'Jarfile', 'Mavenfile', 'Podfile', 'Puppetfile', 'Rakefile', 'Snapfile', 'Thorfile'], ['#'], [('=begin', '=end')], False, ['#!/usr/bin/ruby', '#!/usr/bin/env ruby'], []),
    ('Rust', ['*.rs', '*.rs.in'], ['//', '///', '//!'], [('/*', '*/'), ('/**', '*/'), ('/*!', '*/')], True, [], []),
    ('S-Lang', ['*.sl'], ['%'], [], False, [], []),
    ('SageMath', ['*.sage', '*.sagews'], ['#'], [('"""', '"""'), ("'''", "'''")], False, [], []),
    ('SAS', ['*.sas'], ['*'], [('/*', '*/')], False, [], []),
    ('Sass', ['*.sass'], ['//'], [('/*', '*/')], False, [], []),
    ('Scala', ['*.scala', '*.sc', 'build.sbt'], ['//'], [('/*', '*/')], False, ['#!/usr/bin/env scala', '#!/usr/bin/scala'], ['object', 'class', 'trait', 'def', 'val', 'var', 'extends', 'with']),
    ('Scheme', ['*.scm', '*.ss'], [';'], [('#|', '|#')], True, ['#!/usr/bin/env guile', '#!/usr/bin/guile', '#!/usr/bin/env scheme'], []),
    ('Scilla', ['*.scilla'], [], [('(*', '*)')], False, [], []),
    ('SCSS', ['*.scss'], ['//'], [('/*', '*/')], False, [], []),
    ('Sed', ['*.sed'], ['#'], [], False, [], []),
    ('Seed7', ['*.s7i', '*.sd7'], ['#'], [('(*', '*)')], False, [], []),
    ('Self', ['*.self'], [], [('"', '"')], False, [], []),
    ('ShaderLab', ['*.shader'], ['//'], [('/*', '*/')], False, [], ['Shader', 'SubShader', 'Pass', 'Properties', 'Tags']),
    ('Shakespeare', ['*.spl'], [], [], False, [], []),
    ('Shen', ['*.shen'], ['\\\\'], [('\\\\*', '*\\\\')], False, [], []),
    ('Sieve', ['*.sieve'], ['#'], [], False, [], []),
    ('SKILL', ['*.il', '*.ils'], [';'], [], False, [], []),
    ('Slim', ['*.slim'], ['/', '//'], [], False, [], []),
    ('Slint', ['*.slint'], ['//'], [('/*', '*/')], False, [], []),
    ('Smalltalk', ['*.st'], [], [('"', '"')], False, [], ['Object subclass:', 'instanceVariableNames:', 'classVariableNames:', 'poolDictionaries:', 'self', 'super', 'true', 'false', 'nil']),
    ('Smarty', ['*.tpl'], [], [('{{*', '*}}')], False, [], []),
    ('Smithy', ['*.smithy'], ['//'], [('/*', '*/')], False, [], []),
    ('SNOBOL', ['*.sno', '*.snob', '*.snobol'], ['*'], [], False, [], []),
    ('Solidity', ['*.sol'], ['//'], [('/*', '*/')], False, [], []),
    ('SPARK', ['*.adb', '*.ads'], ['--'], [], False, [], ['pragma SPARK_Mode', 'Global', 'Depends', 'Pre =>', 'Post =>', 'Contract_Cases']),
    ('SPARQL', ['*.rq', '*.sparql'], ['#'], [], False, [], []),
    ('SpiderBasic', ['*.sb', '*.sbi', '*.sbf', '*.sbp'], [';'], [], False, [], []),
    ('SPIR-V', ['*.spvasm', '*.spv'], [';'], [], False, [], []),
    ('SQF', ['*.sqf'], ['//'], [('/*', '*/')], False, [], []),
    ('SQL', ['*.sql', '*.ddl', '*.dml', '*.pgsql', '*.psql', '*.mysql'], ['--'], [('/*', '*/')], False, [], []),
    ('Squirrel', ['*.nut'], ['//'], [('/*', '*/')], False, [], []),
    ('Stan', ['*.stan'], ['//', '#'], [('/*', '*/')], False, [], []),
    ('Standard ML', ['*.sml', '*.sig', '*.fun'], [], [('(*', '*)')], True, [], []),
    ('Stanza', ['*.stanza'], [';'], [('<doc>', '</doc>')], False, [], []),
    ('Starlark', ['*.star'], ['#'], [], False, [], []),
    ('Stata', ['*.do'], ['//', '*'], [('/*', '*/')], False, [], []),
    ('Structured Text', ['*.st', '*.scl'], ['//'], [('(*', '*)')], False, [], ['PROGRAM', 'END_PROGRAM', 'VAR', 'END_VAR', 'FUNCTION_BLOCK', 'END_FUNCTION_BLOCK']),
    ('Stylus', ['*.styl'], ['//'], [('/*', '*/')], False, [], []),
    ('SuperCollider', ['*.sc', '*.scd'], ['//'], [('/*', '*/')], False, [], ['SinOsc', 'SynthDef', 'Server', '~', '.ar', '.kr']),
    ('Svelte', ['*.svelte'], [], [('<!--', '-->')], False, [], []),
    ('SVG', ['*.svg'], [], [('<!--', '-->')], False, [], []),
    ('Sway', ['*.sw'], ['//'], [('/*', '*/')], False, [], []),
    ('Swift', ['*.swift', '*.swiftpm', '*.swiftinterface'], ['//'], [('/*', '*/')], True, [], []),
    ('Swig', ['*.swg', '*.i'], ['//'], [('/*', '*/')], True, [], ['%module', '%include', '%apply', '%typemap', '%inline', '%exception']),
    ('SystemVerilog', ['*.sv', '*.svh'], ['//'], [('/*', '*/')], True, [], ['logic', 'modport', 'interface', 'typedef', 'package', 'virtual', 'class', 'constraint']),
    ('T-SQL', ['*.tsql'], ['--'], [('/*', '*/')], False, [], []),
    ('TADS', ['*.t', '*.tl'], ['//'], [('/*', '*/')], False, [], ['modify', 'replace', 'DefineAction', 'VerbRule', 'Thing', 'gameMain']),
    ('TC Shell', ['*.tcsh'], ['#'], [], False, [], []),
    ('Tcl', ['*.tcl', '*.tk'], ['#'], [], False, ['#!/usr/bin/env tclsh', '#!/usr/bin/tclsh'], []),
    ('Teal', ['*.tl'], ['--'], [('--[[', '--]]')], False, [], ['local', 'global', 'record', 'enum', 'type', 'function', 'end', 'require']),
    ('Templ', ['*.templ'], ['//'], [('/*', '*/')], False, [], []),
    ('Tera', ['*.tera'], [], [('<!--', '-->'), ('{#', '#}')], False, [], []),
    ('Terra', ['*.t'], ['--'], [('--[[', ']]')], False, [], ['terra', 'struct', 'quote', 'escape', 'import']),
    ('Terraform', ['*.tf', '*.tfvars', '*.tf.json', '*.tfvars.json'], ['#', '//'], [('/*', '*/')], False, [], ['terraform', 'provider', 'resource', 'variable', 'module', 'locals', 'data']),
    ('TeX/LaTeX', ['*.tex', '*.sty', '*.bbx', '*.cbx', '*.lbx', '.latexmkrc'], ['%'], [], False, [], []),
    ('Textile', ['*.textile'], [], [], False, [], []),
    ('Thrift', ['*.thrift'], ['#', '//'], [('/*', '*/')], False, [], []),
    ('TLA+', ['*.tla'], ['\\\\'], [('(*', '*)')], False, [], []),
    ('Tmux', ['*.tmux'], ['#'], [], False, [], []),
    ('TOML', ['*.toml', 'Cargo.lock', 'poetry.lock', 'Pipfile.lock', 'uv.lock'], ['#'], [], False, [], []),
    ('Turing', ['*.t', '*.tu'], ['%'], [('/*', '*/')], False, [], ['var', 'put', 'get', 'loop', 'exit', 'proc', 'fcn', 'module']),
    ('Turtle', ['*.ttl'], ['#'], [], False, [], []),
    ('Twig', ['*.twig'], [], [('{#', '#}')], False, [], []),
    ('txt2tags', ['*.t2t'], ['%'], [], False, [], []),
    ('TypeScript', ['*.ts', '*.tsx', '*.d.ts', '*.cts', '*.mts', '*.d.cts', '*.d.mts'], ['//'], [('/*', '*/')], True, [], []),
    ('Typst', ['*.typ'], ['//'], [('/*', '*/')], False, [], []),
    ('Uiua', ['*.uiua'], ['#'], [], False, [], []),
    ('Umka', ['*.um'], ['//'], [('/*', '*/')], False, [], []),
    ('Unicon', ['*.icn'], ['#'], [], False, [], ['procedure', 'method', 'class', 'end', 'every', 'suspend', 'link']),
    ('Unison', ['*.u', '*.uu'], ['--'], [('{-', '-}')], True, [], []),
    ('UnrealScript', ['*.uc'], ['//'], [('/*', '*/')], True, [], []),
    ('Uxntal', ['*.tal'], [], [('(', ')')], False, [], []),
    ('V', ['*.v'], ['//'], [('/*', '*/')], True, [], ['fn', 'struct', 'enum', 'pub', 'mut', 'module', 'match']),
    ('Vala', ['*.vala', '*.vapi'], ['//'], [('/*', '*/')], True, [], []),
    ('Vale', ['*.vale'], ['//'], [('/*', '*/')], False, [], []),
    ('VCL', ['*.vcl'], ['//'], [('/*', '*/')], False, [], []),
    ('Velocity', ['*.vm', '*.vtl'], ['##'], [('#*', '*#')], False, [], []),
    ('Verilog', ['*.v', '*.vh'], ['//'], [('/*', '*/')], True, [], ['module', 'endmodule', 'always', 'assign', 'posedge', 'negedge', 'wire', 'reg']),
    ('Verilog-A', ['*.va', '*.vams'], ['//'], [('/*', '*/')], False, [], ['analog', 'electrical', 'voltage', 'current', 'ddt', 'idt', 'branch']),
    ('Verse', ['*.verse'], ['#'], [('(*', '*)')], False, [], ['module', 'using', 'var', 'class', 'struct', 'interface', 'for', 'if', 'return', 'agent', 'spawns']),
    ('VHDL', ['*.vhd', '*.vhdl'], ['--'], [], False, [], []),
    ('Vim script', ['*.vim', '*.vimrc', '*.gvimrc', '.vimrc', '_vimrc', '.gvimrc', '_gvimrc', 'gvimrc'], ['"'], [], False, [], []),
    ('Visual Basic/Visual Basic .NET', ['*.vb', '*.cls', '*.frm', '*.frx', '*.vba', '*.vbhtml', '*.vbs'], ["'"], [], False, [], ['Dim', 'Sub', 'Function', 'End Sub', 'End Function', 'Private', 'Public', 'As', 'If Then', 'For Each']),
    ('Visual FoxPro', ['*.prg', '*.vcx', '*.scx', '*.pjx', '*.mnx', '*.dbf'], ['*', '&&'], [], False, [], ['DO WHILE', 'ENDDO', 'SCAN', 'ENDSCAN', 'DEFINE CLASS', 'ENDDEFINE', 'PROCEDURE', 'FUNCTION']),
    ('Vue', ['*.vue'], ['//'], [('<!--', '-->'), ('/*', '*/')], True, [], []),
    ('Vyper', ['*.vy'], ['#'], [('"""', '"""'), ("'''", "'''")], False, [], ['contract', 'def', 'event', 'struct', 'public', 'external', 'view', 'pure']),
    ('WDL', ['*.wdl'], ['#', '//'], [('/*', '*/')], False, [], []),
    ('Web Services Description Language', ['*.wsdl'], [], [('<!--', '-->')], False, [], []),
    ('WebAssembly', ['*.wat', '*.wasm'], [';;'], [('(;', ';)')], True, [], []),
    ('WebGPU Shading Language', ['*.wgsl'], ['//'], [('/*', '*/')], False, [], []),
    ('WebIDL', ['*.webidl'], ['//'], [('/*', '*/')], False, [], []),
    ('Wenyan', ['*.wy'], ['注曰', '//'], [('凡', '是謂')], False, [], []),
    ('Whitespace', ['*.ws'], [], [], False, [], []),
    ('Windows Registry Entry', ['*.reg'], [';', '#'], [], False, [], []),
    ('Windows Resource File', ['*.rc'], ['//'], [('/*', '*/')], True, [], []),
    ('WIT', ['*.wit'], ['//'], [('/*', '*/')], False, [], []),
    ('WiX', ['*.wxs'], [], [('<!--', '-->')], False, [], []),
    ('Wren', ['*.wren'], ['//'], [('/*', '*/')], False, [], []),
    ('X++', ['*.xpp'], ['//'], [('/*', '*/')], False, [], []),
    ('X10', ['*.x10'], ['//'], [('/*', '*/')], False, [], []),
    ('Xcode Config', ['*.xcconfig'], ['//'], [], False, [], []),
    ('XML', ['*.xml', '*.xsl', '*.xslt'], [], [('<!--', '-->')], False, [], []),
    ('XML Schema Definition', ['*.xsd'], [], [], False, [], []),
    ('Xonsh', ['*.xsh'], ['#'], [], False, ['#!/usr/bin/env xonsh', '#!/usr/bin/xonsh'], []),
    ('XQuery', ['*.xq', '*.xql', '*.xqm', '*.xqy', '*.xquery'], [], [('(:', ':)')], False, [], ['declare', 'namespace', 'module', 'import', 'for', 'let', 'return', 'where', 'if', 'then', 'else']),
    ('Xtend', ['*.xtend'], ['//'], [('/*', '*/')], False, [], []),
    ('Yacc', ['*.y', '*.yacc'], ['//'], [('/*', '*/')], False, [], ['%token', '%type', '%start', 'yyparse']),
    ('YAML', ['*.yaml', '*.yml', '*.yaml.tmpl', '*.yaml-tmpl', '.yamllint', '.clang-format', '.clang-tidy', '.gemrc', 'pnpm-lock.yaml', 'pubspec.lock', 'Podfile.lock'], ['#'], [], False, [], []),
    ('YANG', ['*.yang'], ['//'], [('/*', '*/')], False, [], []),
    ('YARA', ['*.yar', '*.yara'], ['//'], [('/*', '*/')], False, [], []),
    ('Yorick', ['*.i'], ['//'], [('/*', '*/')], False, [], ['func', 'struct', 'extern', 'local', 'include', 'require']),
    ('ZenCode', ['*.zs'], ['//', '#'], [('/*', '*/')], False, [], []),
    ('Zephir', ['*.zep'], ['//'], [('/*', '*/')], False, [], []),
    ('Zig', ['*.zig'], ['//', '///', '//!'], [], False, [], []),
    ('Ziggy', ['*.ziggy'], ['#'], [], False, [], []),
    ('ZIL', ['*.zil', '*.mud'], [';'], [], False, [], []),
    ('ZoKrates', ['*.zok'], ['//'], [('/*', '*/')], False, [], []),
    ('Zon', ['*.zon'], ['//', '///', '//!'], [], False, [], []),
    ('ZSH', ['*.zsh', '.zlogin', '.zlogout', '.zprofile', '.zshenv', '.zshrc'], ['#'], [], False, ['#!/bin/zsh'], []),
]
